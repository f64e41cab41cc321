"""Statistics of texts that tell prose from lists, tables and junk.

Texts are cut into chunks (at a place that splits no word of ordinary length), each chunk gives counts, and the counts
of a text's chunks are merged in order, in a tree. A chunk's state is a monoid: the sums over its complete lines, and the counts of
the unfinished lines at its two ends; merging joins one's last line to the other's first. Only when a line is complete is it
taken for running words, a row, an entry or something else. Distinct words, and distinct pairs of ideographs, kana or the like (which
have no blanks between words), are counted in a bit map each; they merge by OR.

No language is known beforehand. A line is judged by its structure:
- running words: 5 words or more (8 after a list mark), more than 3 for each separated piece, few digits; or 6 characters of a script without blanks;
- a row has separators between cells of 4 words at most;
- an entry has at most 7 words, or a list mark.
Running words are sentences if the text ends them with stops, or if many of them are short: in nearly all languages with blanks
particles, articles and prepositions of up to three letters make up more than a tenth of the words. See ``judge``. Common words, for their share among the statistics,
are those in most documents of the corpus (``common_words``); the kinds don't depend on them.

Defined cases: null, empty and blank texts have statistics of 0 and no kind; each row of the input is judged by itself, repeated
ids included; other columns are ignored.
"""

from __future__ import annotations

import math
import operator
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.sources.tables import Stage


def _marks() -> str:
    """Character class ranges of all combining marks, which Python's \\w leaves out; many scripts need them within words."""
    codes = [c for c in range(0x300, min(sys.maxunicode, 0x1FFFF)) if unicodedata.category(chr(c))[0] == "M"]
    starts = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i == len(codes) - 1 or codes[i + 1] != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


_W = rf"[\w{_marks()}]"
_WORD = re.compile(rf"{_W}+(?:[-'’/]{_W}+)*")
_ASCII_WORD = re.compile(r"\w+(?:[-'/]\w+)*")
_GAP = re.compile(r"\t|\s{2,}")
_MARKUP = re.compile(r"<[^<>\n]{1,200}>|&[a-z]{2,8};|\{[^{}\n]{0,200}\}")
_BROKEN = re.compile(r"[\x80-\x9f�]|[ÃÂÐÑâæåèéäçï][\x80-\xbf]")
# scripts without blanks between words: kana, ideographs, hangul (short words), Thai, Lao, Myanmar, Khmer, Tibetan
_WIDE_RUN = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u0f00-\u0fff]+")
_MARK = re.compile(r"\s*([-*+•·–▪‣◦]|\[[ xX]\]|\(?\w{1,2}[.)])\s")
_BREAK = re.compile("[\r\n\v\f\x85\u2028\u2029]")
_DIGITS = re.compile(r"\d+")
_OTHER = re.compile(rf"[^\w{_marks()}]+|_+")
_ASCII_OTHER = bytes(c for c in range(128) if not chr(c).isalnum())
#: A sentence's end: a stop after a word, before a blank, a closing sign or the end, or a stop that needs no blank.
_END = re.compile(rf"[\w{_marks()}%][\"'”’»)\]]*[.!?…]+(?=[\s\"'”’»)\]]|$)|[。！？।॥؟։።]")
_STOPS = ".!?…。！？：;»”\"'।॥؟։።"

CHUNK, SEAM, BITS = 1 << 18, 256, 2048
#: Counts of a line, in order. ``marked`` counts list marks at a line's start, ``stop`` sentence ends at its end.
LINE = ("chars", "words", "letters", "common", "short", "alnum", "digits", "wide", "markup", "broken", "long", "cells", "pieces", "gaps", "ends", "marked", "stop")
#: Sums of a text: those of its lines, the number of lines, and lines and characters of each kind.
TEXT = (*LINE, "lines", "sentence_lines", "row_lines", "entry_lines", "sentence_chars", "row_chars", "entry_chars", "running", "running_short", "running_ends")
_AT = {k: i for i, k in enumerate(TEXT)}


def _line(text: str, start: bool, seen: set[str], pairs: set[str], common: frozenset[str]) -> list[int]:
    """The counts of a line, or of a part of it; only a part from the line's start can have a list mark."""
    mark = _MARK.match(text) if start else None
    bare = text.strip()
    plain = text.isascii()
    found = (_ASCII_WORD if plain else _WORD).findall((text[mark.end() :] if mark else text).lower())
    seen.update(found)
    wide = [] if plain else _WIDE_RUN.findall(text)
    for run in wide:
        pairs.update(map("".join, zip(run, run[1:])) if len(run) > 1 else run)
    sizes = list(map(len, found))
    if plain:
        alnum = len(text.encode().translate(None, _ASCII_OTHER))
        digits = len(text) - len(text.encode().translate(None, b"0123456789"))
    else:
        alnum, digits = len(_OTHER.sub("", text)), sum(map(len, _DIGITS.findall(text)))
    inner = bare.strip("|│")
    bars = inner.count("|") + inner.count("│") + inner.count('" "')
    gaps = len(_GAP.findall(inner)) if not plain or "\t" in inner or "  " in inner else 0
    return [
        len("".join(text.split())),
        len(found),
        sum(sizes),
        sum(map(common.__contains__, found)) if common else 0,
        sum(n <= 3 and (w.isalpha() or not any(map(str.isdigit, w))) for w, n in zip(found, sizes)),
        alnum,
        digits,
        sum(map(len, wide)),
        sum(map(len, _MARKUP.findall(text))) if "<" in text or "&" in text or "{" in text else 0,
        0 if plain else sum(map(len, _BROKEN.findall(text))),
        sum(n for n in sizes if n >= 24),
        bars + gaps + inner.count(",") + inner.count(";"),
        bars + inner.count(", ") + inner.count("; "),
        gaps,
        len(_END.findall(bare)) if not plain or "." in bare or "?" in bare or "!" in bare else 0,
        int(bool(mark)),
        int(bare[-1:] in _STOPS and bare != ""),
    ]


def _join(a: list[int], b: list[int]) -> list[int]:
    """Two parts of one line."""
    if not a[0]:
        return b
    if not b[0]:
        return a
    return [*[x + y for x, y in zip(a[:-2], b[:-2])], a[-2], b[-1]]


def _close(total: list[int], line: list[int]) -> None:
    """Adds a complete line to the sums."""
    chars, n, short, digits, wide, cells, pieces, gaps, ends, marked = (line[_AT[k]] for k in ("chars", "words", "short", "digits", "wide", "cells", "pieces", "gaps", "ends", "marked"))
    if not chars:
        return
    total[: len(line)] = map(operator.add, total, line)
    total[_AT["lines"]] += 1
    loose = short >= 0.2 * n and digits <= 0.1 * chars  # odd spacing in a sentence, not columns
    if (n >= (8 if marked else 5) and n > 3 * (pieces + (0 if loose else gaps) + 1) and digits <= 0.3 * chars) or wide >= 6:
        kind = "sentence"
        for k, x in (("running", n), ("running_short", short), ("running_ends", ends)):
            total[_AT[k]] += x
    elif cells and (digits > 0.12 * chars or cells >= 2) and n <= 4 * (cells + 1):
        kind = "row"
    elif n <= 7 or marked:
        kind = "entry"
    else:
        return
    total[_AT[f"{kind}_lines"]] += 1
    total[_AT[f"{kind}_chars"]] += chars


def _bits(items: set[str]) -> int:
    out = bytearray(BITS // 8)
    for w in items:
        k = zlib.crc32(w.encode("utf-8", "replace")) % BITS
        out[k >> 3] |= 1 << (k & 7)
    return int.from_bytes(out, "little")


def chunk_state(text: str, common: frozenset[str] = frozenset(), begin: bool = True) -> tuple[list[int], list[int], list[int], bool, bytes]:
    """(sums of the complete lines, first line, last line, whether there is a line break, bit maps of words and wide pairs).

    Without a line break all counts are in the first line. ``begin`` tells that the first line starts here.
    """
    total, seen, pairs = [0] * len(TEXT), set(), set()
    lines = _BREAK.split(text)
    first = _line(lines[0], begin, seen, pairs, common)
    last = _line(lines[-1], True, seen, pairs, common) if len(lines) > 1 else [0] * len(LINE)
    for line in lines[1:-1]:
        if line:
            _close(total, _line(line, True, seen, pairs, common))
    return total, first, last, len(lines) > 1, (_bits(seen) | _bits(pairs) << BITS).to_bytes(BITS // 4, "little")


def merge_states(a, b):
    """The state of two adjacent chunks. Associative."""
    total = [x + y for x, y in zip(a[0], b[0])]
    bits = (int.from_bytes(a[4], "little") | int.from_bytes(b[4], "little")).to_bytes(BITS // 4, "little")
    if a[3] and b[3]:
        _close(total, _join(a[2], b[1]))
        return total, a[1], b[2], True, bits
    if a[3]:
        return total, a[1], _join(a[2], b[1]), True, bits
    return total, _join(a[1], b[1]), b[2], b[3], bits


def finish(state) -> dict[str, float]:
    """The statistics of a whole text."""
    total = list(state[0])
    _close(total, state[1])
    _close(total, state[2])
    t = dict(zip(TEXT, total))
    half = BITS // 8
    distinct, pairs = (BITS * math.log(BITS / max(1, BITS - int.from_bytes(b, "little").bit_count())) for b in (state[4][:half], state[4][half:]))
    w, c, n = max(1, t["words"]), max(1, t["chars"]), max(1, t["lines"])
    return {
        "n_words": t["words"],
        "n_lines": t["lines"],
        "n_chars": t["chars"],
        "mean_word_length": t["letters"] / w,
        "symbol_share": (t["chars"] - t["alnum"]) / c,
        "digit_share": t["digits"] / c,
        "stop_line_share": t["stop"] / n,
        "common_share": t["common"] / w,
        "distinct_share": min(1.0, distinct / w),
        "distinct_pairs": round(pairs, 1),
        "wide_share": t["wide"] / c,
        "markup_share": t["markup"] / c,
        "broken_share": t["broken"] / c,
        "long_share": t["long"] / c,
        "sentence_share": t["sentence_chars"] / c,
        "row_share": t["row_chars"] / c,
        "entry_share": t["entry_chars"] / c,
        "sentence_lines": t["sentence_lines"],
        "row_lines": t["row_lines"],
        "entry_lines": t["entry_lines"],
        "short_share": t["running_short"] / max(1, t["running"]),
        "n_ends": t["running_ends"],
        "words_an_end": t["running"] / t["running_ends"] if t["running_ends"] else 0.0,
    }


def _repeated(n: float, distinct: float) -> bool:
    """Few words (or pairs of characters) over and over: at most a tenth are distinct, or in a short text fewer than its root, which ordinary
    text has by far. A long text has a small share of distinct words as well, but many of them."""
    return 0.5 < distinct <= min(100, max(0.1 * n, math.sqrt(n) - 1) + 0.1)


def judge(s: dict[str, float]) -> str | None:
    """prose, list, table or junk; None for a text without visible characters."""
    if not s["n_chars"]:
        return None
    repeated = _repeated(s["n_words"], s["distinct_share"] * s["n_words"]) or (s["wide_share"] > 0.5 and _repeated(s["wide_share"] * s["n_chars"], s["distinct_pairs"]))
    if s["broken_share"] > 0.04 or s["markup_share"] > 0.3 or s["symbol_share"] > 0.8 or repeated:
        return "junk"
    listed = s["entry_lines"] >= 5 and s["entry_lines"] >= 2 * s["sentence_lines"] and s["entry_share"] >= 0.15  # a long passage among entries
    if s["symbol_share"] > 0.2 and s["row_share"] + s["entry_share"] < 0.5:
        return "junk"
    ended = 0 < s["words_an_end"] <= 25 and (s["short_share"] >= 0.1 or s["n_ends"] >= 2)
    if s["sentence_share"] >= (0.8 if listed else 0.5) and (s["short_share"] >= 0.15 or ended or s["wide_share"] > 0.3):
        return "prose"
    if s["long_share"] > 0.5:
        return "junk"
    if s["row_lines"] >= 3 and s["row_share"] >= 0.5:
        return "table"
    if s["symbol_share"] > 0.35:
        return "junk"
    return "list" if s["entry_share"] + s["row_share"] + (s["sentence_share"] if listed else 0) >= 0.5 else "junk"


STATS = {k: "bigint" if k.startswith("n_") or k.endswith("_lines") else "double" for k in finish(chunk_state(""))}
_FIELDS = ("total", "first", "last", "broken", "bits")
_STATE = "total array<bigint>, first array<bigint>, last array<bigint>, broken boolean, bits binary"


def _cut(text: str, begin: bool, end: bool) -> str:
    """A chunk without what belongs to its neighbours: ends move on to the first white space within the seam, if there is
    any. Both neighbours see that place. Only markup with blanks in it, and runs of blanks, can still be cut."""

    def seam(part: str) -> int:
        return next((i for i, c in enumerate(part[:SEAM]) if c.isspace()), 0)

    lo = 0 if begin else seam(text)
    hi = len(text) if end else CHUNK + seam(text[CHUNK:])
    return text[lo:hi]


def common_words(docs: DataFrame, text_col: str = "text", n: int = 500) -> list[str]:
    """The ``n`` words of up to 12 letters that stand in most documents, over all documents. Only these reach the driver."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(r"(?<![\p{L}\p{M}\p{N}_])[\p{L}\p{M}]{1,12}(?![\p{L}\p{M}\p{N}_])"), F.lit(0)))
    words = docs.where(F.col(text_col).isNotNull()).select(F.explode(found).alias("w"))
    return [r.w for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(n).collect()]


def text_statistics(docs: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text", common: list[str] | None = None) -> DataFrame:
    """(id_col, statistics..., kind): one row per row of ``docs``. ``common_share`` is 0 without ``common`` words.

    The texts are read once; those of one chunk, nearly all, are finished where they are. The chunks of the others are spread over the
    tasks, and their states merged in a tree of 256 branches, of which two levels hold any string.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    known = frozenset(common or ())
    stats = [*STATS, "kind"]
    stats_schema = ", ".join(f"{k} {t}" for k, t in STATS.items()) + ", kind string"
    length = F.length(F.coalesce(F.col(text_col), F.lit("")))
    chunks = F.greatest(F.lit(1), F.ceil(length / F.lit(CHUNK))).cast("int")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), chunks.alias("chunks")).withColumn("row", F.monotonically_increasing_id())
    parts = rows.select("row", "id", "chunks", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.substring("text", k * CHUNK + 1, F.lit(CHUNK + SEAM)))).alias("k", "part"))

    def measured(state) -> dict:
        s = finish(state)
        return s | {"kind": judge(s)}

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            one = pdf["chunks"] == 1
            done = pd.DataFrame([measured(chunk_state(t, known)) for t in pdf["part"][one]], columns=stats)
            yield pd.concat([pdf[one][["row", "id", "chunks", "k"]].reset_index(drop=True).assign(part=None), done], axis=1)
            if not one.all():
                yield pdf[~one][["row", "id", "chunks", "k", "part"]].assign(**dict.fromkeys(stats))

    scanned = stage.put(parts.mapInPandas(first, f"row bigint, id {kind}, chunks int, k int, part string, {stats_schema}"))
    short = scanned.where("chunks = 1").select("id", *stats)
    long = scanned.where("chunks > 1").select("row", "id", "chunks", "k", "part")
    if long.isEmpty():
        return short.withColumnRenamed("id", id_col)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            states = [chunk_state(_cut(p, k == 0, k == n - 1), known, k == 0) for p, k, n in zip(pdf["part"], pdf["k"], pdf["chunks"])]
            yield pdf[["row", "id", "k"]].assign(**{c: [s[i] for s in states] for i, c in enumerate(_FIELDS)})

    def merged(parts) -> tuple:
        parts = [tuple(p[c] for c in _FIELDS) for p in parts]
        while len(parts) > 1:  # merging is associative
            parts = [merge_states(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def branch(df: DataFrame, *key) -> DataFrame:
        return df.groupBy("row", *key).agg(F.first("id").alias("id"), F.min("k").alias("k"), F.sort_array(F.collect_list(F.struct("k", *_FIELDS))).alias("states"))

    def inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            states = [merged(p) for p in pdf["states"]]
            yield pdf[["row", "id", "k"]].assign(**{c: [s[i] for s in states] for i, c in enumerate(_FIELDS)})

    def root(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.concat([pdf[["id"]].reset_index(drop=True), pd.DataFrame([measured(merged(p)) for p in pdf["states"]], columns=stats)], axis=1)

    state_schema = f"row bigint, id {kind}, k int, {_STATE}"
    states = long.repartition("row", "k").mapInPandas(count, state_schema)
    half = branch(states, F.floor(F.col("k") / 256)).select("row", "id", "k", "states").mapInPandas(inner, state_schema)
    whole = branch(half).select("id", "states").mapInPandas(root, f"id {kind}, {stats_schema}")
    return short.unionByName(whole).withColumnRenamed("id", id_col)
