"""Evaluation items that leak into a corpus: an inverted BM25 index of the items, queried with every passage.

Every text is cut into overlapping windows of twice the run length, so that any run of that many consecutive words
lies in one window. A window's BM25 score for an item is the sum of the item's weights of the window's distinct
words. An item's threshold is the least score of any of its own runs, so a window that holds a run can't score
less: retrieval above the threshold loses nothing. What is retrieved is verified word by word.

The index has a posting list per term, in the order of the items and cut into blocks with their maxima. As in WAND, terms that together
weigh less than an item's threshold can't bring it over (the pivot): an item is posted only under its other terms, the rare ones, and
what the left-out terms can add is kept per item. A window first adds up the block maxima of its terms; blocks that stay below the
least an item of theirs needs are skipped, the postings of the others are added up per item, and an item over its need is scored in full.

The index holds the items only, which are few against the corpus: the driver collects at most ``items_at_once`` items and
``chars_at_once`` characters, and workers read the index from one broadcast. The corpus is read and split into words once for that many items.

Defined cases: null texts and ids, and items without words, give no rows; repeated rows of a text or item come out once;
an empty corpus or item table gives no rows. Words are maximal runs of letters and digits in lower case.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
BLOCK = 16  # items of a posting block at most
CELLS = 1 << 21  # windows x blocks that are bounded at once


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and the range of each."""
    size = stop - start
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size), owner


class ItemIndex:
    """Posting lists, block maxima and thresholds of a bounded number of items. Flat arrays: a few tens of bytes a word of an item."""

    def __init__(self, items: list[tuple[int, str]], run: int = 12, k1: float = 1.2, b: float = 0.75):
        self.run = run
        split = [(i, w) for i, t in items if (w := words(t))]
        self.ids = [i for i, _ in split]
        self.length = [min(run, len(w)) for _, w in split]
        self.runs = [frozenset(" ".join(w[s : s + run]) for s in range(max(1, len(w) - run + 1))) for _, w in split]
        n = len(split)
        counts = Counter(t for _, w in split for t in set(w))
        self.terms = {t: k for k, t in enumerate(sorted(counts))}
        df = np.array([counts[t] for t in self.terms], float)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        mean = sum(len(w) for _, w in split) / max(1, n)
        need, posted, all_ = np.zeros(n), [], []
        self.threshold = np.zeros(n)
        for i, (_, w) in enumerate(split):
            own = {t: idf[self.terms[t]] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / mean)) for t, tf in Counter(w).items()}
            self.threshold[i] = least = min(sum(own[t] for t in set(w[s : s + run])) for s in range(max(1, len(w) - run + 1))) * (1 - 1e-6)
            left, ranked = 0.0, sorted(own, key=lambda t: (own[t], t))
            while ranked and left + own[ranked[0]] < least:
                left += own[ranked.pop(0)]
            need[i] = least - left
            posted += [(self.terms[t], i, own[t]) for t in ranked]
            all_ += [(i * len(self.terms) + self.terms[t], x) for t, x in own.items()]
        # every weight by (item, term), for the full score
        all_.sort()
        self.pair, self.weight = np.array([k for k, _ in all_], np.int64), np.array([x for _, x in all_], float)
        self.table = None
        if n * len(self.terms) <= CELLS:  # a plain table is small
            self.table = np.zeros(n * len(self.terms))
            self.table[self.pair] = self.weight
        # postings by term and item; blocks of neighbouring items, the same for all terms
        posted.sort()
        term, self.item, self.post = (np.array([p[k] for p in posted], t) for k, t in enumerate((np.int64, np.int64, float)))
        self.need = np.concatenate([need * (1 - 1e-9), np.full(-n % BLOCK, np.inf)])
        self.block_need = self.need.reshape(-1, BLOCK).min(axis=1)
        cut = np.flatnonzero(np.diff(term * (n + 1) + self.item // BLOCK, prepend=-1)) if n else np.empty(0, np.int64)
        self.block_start, self.block_stop = cut, np.append(cut[1:], len(term))
        self.block, self.block_max = self.item[cut] // BLOCK, np.maximum.reduceat(self.post, cut) if n else self.post
        self.list_start = np.searchsorted(term[cut], np.arange(len(self.terms)))
        self.list_stop = np.searchsorted(term[cut], np.arange(len(self.terms)), "right")

    def _weights(self, key: np.ndarray) -> np.ndarray:
        """The weight of each item x terms + term, 0 where the item hasn't the term."""
        if self.table is not None:
            return self.table[key]
        found = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[found] == key, self.weight[found], 0.0)

    def retrieve(self, window: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that score at least the item's threshold; (window, term) are distinct and sorted by window."""
        step = max(1, CELLS // len(self.block_need))
        edges = np.searchsorted(window, np.arange(window[0], window[-1] + step + 1, step)) if len(window) else [0]
        found = [self._retrieve(window[lo:hi], term[lo:hi]) for lo, hi in zip(edges[:-1], edges[1:]) if hi > lo]
        return tuple(np.concatenate([np.empty(0, np.int64), *[f[k] for f in found]]) for k in range(2))

    def _retrieve(self, window: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_blocks, n_terms, base = len(self.block_need), len(self.terms), window[0]
        span = int(window[-1] - base) + 1
        # blocks: the sum of the maxima of a window's terms
        at, owner = _spread(self.list_start[term], self.list_stop[term])
        cell = (window[owner] - base) * n_blocks + self.block[at]
        bound = np.bincount(cell, self.block_max[at], span * n_blocks)
        good = bound >= np.tile(self.block_need, span)
        number = np.cumsum(good) - 1
        kept = good[cell]
        # items of the blocks that are left
        place, of = _spread(self.block_start[at[kept]], self.block_stop[at[kept]])
        where = np.flatnonzero(good)
        score = np.bincount(number[cell[kept]][of] * BLOCK + self.item[place] % BLOCK, self.post[place], len(where) * BLOCK)
        need = self.need[(where[:, None] % n_blocks) * BLOCK + np.arange(BLOCK)].ravel()
        hit = np.flatnonzero(score >= need)
        w, item = where[hit // BLOCK] // n_blocks, (where[hit // BLOCK] % n_blocks) * BLOCK + hit % BLOCK
        # the full score of those
        first = np.searchsorted(window, np.arange(base, base + span + 1))
        place, of = _spread(first[w], first[w + 1])
        key = item[of] * n_terms + term[place]
        full = np.bincount(of, self._weights(key), len(w))
        ok = full >= self.threshold[item]
        return w[ok] + base, item[ok]

    def search(self, texts: list[str]) -> list[tuple[int, int]]:
        """(place of a text, item id) of every leak."""
        if not self.ids:
            return []
        run = self.run
        split = [words(t) for t in texts]
        term = np.array([*map(self.terms.get, itertools.chain.from_iterable(split), itertools.repeat(-1))], np.int64)
        counts = np.array([len(ws) for ws in split])
        place = np.arange(len(term)) - np.repeat(np.cumsum(counts) - counts, counts)
        windows = np.maximum(1, -(-counts // run))
        base = np.cumsum(windows) - windows
        ok = term >= 0
        window = np.repeat(base, counts)[ok] + place[ok] // run
        earlier = place[ok] >= run  # a word also lies in the window before
        term = term[ok]
        pair = np.unique(np.concatenate([window, window[earlier] - 1]) * len(self.terms) + np.concatenate([term, term[earlier]]))
        window, item = self.retrieve(*np.divmod(pair, len(self.terms)))
        text = np.repeat(np.arange(len(split)), windows)[window]
        found, grams, last = set(), {}, -1
        for d, w, i in zip(text.tolist(), window.tolist(), item.tolist()):
            if (d, self.ids[i]) in found:
                continue
            if w != last:
                last, grams, own = w, {}, split[d][(w - base[d]) * run : (w - base[d] + 2) * run]
            n = self.length[i]
            if n not in grams:
                grams[n] = {" ".join(own[s : s + n]) for s in range(len(own) - n + 1)}
            if not grams[n].isdisjoint(self.runs[i]):
                found.add((d, self.ids[i]))
        return sorted(found)


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", run: int = 12, items_at_once: int = 1 << 17, chars_at_once: int = 1 << 25) -> DataFrame:
    """(doc_id, item_id): texts that hold ``run`` consecutive words of an item, or all words of a shorter one."""
    spark = docs.sparkSession
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}"
    clean = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).distinct()
    n, chars = clean.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    corpus = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    out = spark.createDataFrame([], schema)
    parts = max(-(-n // items_at_once), -(-chars // chars_at_once))
    for part in range(parts):
        own = sorted((r.i, r.t) for r in clean.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).collect())
        shared = spark.sparkContext.broadcast(ItemIndex(own, run))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value

            def flush(ids, texts, id_type):
                hits = index.search(texts)
                return pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _ in hits], id_type), pa.array([i for _, i in hits], pa.int64() if kinds[1] == "bigint" else None)], ["doc_id", "item_id"])

            for b in batches:
                id_type = b.column(0).type
                ids, texts, size = [], [], 0
                for d, t in zip(b.column(0), b.column(1)):
                    t = t.as_py()
                    ids.append(d.as_py())
                    texts.append(t)
                    size += len(t)
                    if size > 1_000_000:
                        yield flush(ids, texts, id_type)
                        ids, texts, size = [], [], 0
                if texts:
                    yield flush(ids, texts, id_type)

        out = corpus.mapInArrow(search, schema) if parts == 1 else out.unionByName(corpus.mapInArrow(search, schema))
    return out.distinct()
