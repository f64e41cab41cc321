"""Tokenizer encoding, leaks and text statistics."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import bpe, leaks, quality

needs_vocabulary = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="needs the public vocabulary")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_vocabulary(None)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


@needs_vocabulary
def test_encoding_equals_library(ranks, reference):
    encoder, decoder = bpe.Encoder(ranks), bpe.Decoder(ranks)

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.one_of(st.sampled_from("abcdefgh  ABC'st012.,\n\t-="), st.characters(exclude_categories=["Cs", "Cn"])), max_size=120))
    def same(text):
        ids = encoder.encode(text)
        assert ids == reference.encode(text, add_special_tokens=False).ids
        assert decoder.decode(ids) == text

    same()
    for text in ("", "a" * 3000, "ab" * 2000, " " * 1000 + "x", "<|endoftext|>", "=-" * 1500, "the the thethe"):
        assert encoder.encode(text) == reference.encode(text, add_special_tokens=False).ids


@needs_vocabulary
def test_encode_column(spark, ranks, reference):
    df = spark.createDataFrame([(1, "hello world", 9), (2, "", 9), (3, None, 9), (3, "again", 9)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_column(df, "doc_id", "text", ranks).collect())
    assert got == [(1, reference.encode("hello world").ids), (2, []), (3, []), (3, reference.encode("again").ids)]
    assert bpe.encode_column(df.where("false"), "doc_id", "text", ranks).count() == 0
    assert all(r.same for r in bpe.roundtrip(df, "doc_id", "text", ranks).collect())


def brute_leaks(docs, items, run=12):
    out = set()
    for d, text in docs:
        w = leaks.words(text)
        for i, item in items:
            q = leaks.words(item)
            n = min(run, len(q))
            if n and {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} & {tuple(q[k : k + n]) for k in range(len(q) - n + 1)}:
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "a"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 11, 12, 13, 40])))) for i in range(40)] + [(90, None), (91, " ... ")]
    docs = []
    for d in range(150):
        w = rng.choices(vocabulary, k=rng.randrange(120))
        if d % 2:
            q = leaks.words(rng.choice(items[:40])[1])
            n = rng.choice([11, 12, 13, 99])
            s = rng.randrange(max(1, len(q) - n + 1))
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + rng.choice(["", ",", " -"]) for x in q[s : s + n]]
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, ""), (502, docs[1][1] * 30), (1, docs[1][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    item_frame = spark.createDataFrame([(*x, "t") for x in items], "item_id long, item_text string, text string")
    want = brute_leaks([x for x in docs if x[1]], [x for x in items if x[1]])
    for at_once in (1 << 17, 7):
        assert {tuple(r) for r in leaks.find_leaks(frame, item_frame, items_at_once=at_once).collect()} == want
    assert leaks.find_leaks(frame.where("false"), item_frame).count() == 0
    assert leaks.find_leaks(frame, item_frame.where("false")).count() == 0


def test_many_items_take_one_scan(spark):
    rng = random.Random(3)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(9000)]
    word = lambda: rng.choice(common) if rng.random() < 0.6 else rng.choice(rare)
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 12, 14, 30])))) for i in range(5000)]
    docs = []
    for d in range(400):
        w = [word() for _ in range(rng.randrange(150))]
        if d % 2:
            q = rng.choice(items)[1].split(" ")
            s = rng.randrange(max(1, len(q) - 11))
            w[len(w) // 2 : len(w) // 2] = q[s : s + 12 - (d % 4 == 1)]
        docs.append((d, " ".join(w)))
    found = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan
    runs = {}
    for i, item in items:
        q = item.split(" ")
        for k in range(max(1, len(q) - 11)):
            runs.setdefault(tuple(q[k : k + 12]), set()).add(i)
    want = set()
    for d, text in docs:
        w = text.split(" ")
        for n in {len(r) for r in runs}:
            for k in range(len(w) - n + 1):
                want |= {(d, i) for i in runs.get(tuple(w[k : k + n]), ())}
    assert {tuple(r) for r in found.collect()} == want and len(want) > 100


TEXTS = {
    "prose": "The ferry was late, and nobody on the quay could say why it had not left. We waited for an hour.\nThen the captain came back with a lantern and told us that the tide was wrong.",
    "list": "- fee per byte\n- rename cluster 4\n- block 699425\n- output count\n- weight\n- change address",
    "table": "fee;rate;profile\n120;4.5;Coinbase\n88;3.1;Unknown\n970;12.9;Unknown\n15;1.1;Coinbase",
    "junk": "wallet dust " * 80,
}


@pytest.mark.parametrize("kind", sorted(TEXTS))
def test_kinds(kind):
    assert quality.judge(quality.finish(quality.chunk_state(TEXTS[kind]))) == kind


def test_noise_with_separators_is_junk_and_long_prose_is_not():
    noise = "\n".join("█|░ ▒|▓ =|#  <|>" for _ in range(20))
    assert quality.judge(quality.finish(quality.chunk_state(noise))) == "junk"
    rng = random.Random(1)
    names = [f"name{i}" for i in range(400)]
    long = "\n".join(f"The {rng.choice(names)} was in the {rng.choice(names)} of a {rng.choice(names)}, and it is not what we had." for _ in range(1500))
    assert quality.judge(quality.finish(quality.chunk_state(long))) == "prose"


@pytest.mark.parametrize("text", ["copy of " * 28 + "copy", "and so on " * 8, "no no no no no no", "复制粘贴" * 12, "같은말" * 20])
def test_short_repetition_is_junk(text):
    assert quality.judge(quality.finish(quality.chunk_state(text))) == "junk"


@pytest.mark.parametrize("text", ["We had a look at it and it is what it was.", "这笔交易的费用很高，我们还不知道原因，明天再看一次。", "The fee of the fee is the fee that we had, and so it was."])
def test_short_sentences_are_prose(text):
    assert quality.judge(quality.finish(quality.chunk_state(text))) == "prose"


#: Plain sentences in languages and scripts that no rule was made for.
SENTENCES = {
    "tr": "Dün akşam eski limana gittik ve uzun süre denizi seyrettik. Hava soğuktu ama kimse eve dönmek istemedi. Sonunda küçük bir lokantada çorba içtik.",
    "ar": "ذهبنا أمس إلى السوق القديم واشترينا بعض الكتب. كان الجو حارا جدا، ولكننا بقينا هناك حتى المساء. ثم عدنا إلى البيت متعبين.",
    "hi": "कल शाम हम पुराने बाज़ार गए और वहाँ बहुत देर तक घूमते रहे। मौसम ठंडा था, लेकिन किसी को घर लौटने की जल्दी नहीं थी। अंत में हमने एक छोटी दुकान पर चाय पी।",
    "sv": "Igår kväll gick vi ner till den gamla hamnen. Det blåste hårt och ingen av oss hade tagit med sig en varm jacka. Ändå stannade vi kvar tills solen hade gått ner.",
    "en": "The city council approved a new budget on Tuesday. Local shops expect higher rents next year. Several members voted against the plan. A final decision is due in March.",
    "it": "Ieri sera siamo andati al porto vecchio. Faceva freddo, ma nessuno voleva tornare a casa. Alla fine abbiamo mangiato una zuppa.",
    "pl": "Wczoraj wieczorem poszliśmy do starego portu. Było zimno, ale nikt nie chciał wracać do domu.",
    "fi": "Eilen illalla kävelimme vanhaan satamaan ja katselimme merta pitkään. Ilma oli kylmä, mutta kukaan ei halunnut lähteä kotiin.",
    "el": "Χθες το βράδυ πήγαμε στο παλιό λιμάνι. Έκανε κρύο, αλλά κανείς δεν ήθελε να γυρίσει σπίτι.",
    "th": "เมื่อวานเย็นเราไปที่ท่าเรือเก่าและนั่งดูทะเลอยู่นาน อากาศหนาวแต่ไม่มีใครอยากกลับบ้าน",
    "hu": "Tegnap este lementünk a régi kikötőbe. Hideg volt, de senki sem akart hazamenni. Végül egy kis vendéglőben ettünk levest.",
    "ta": "நேற்று மாலை நாங்கள் பழைய துறைமுகத்திற்குச் சென்றோம். குளிராக இருந்தது, ஆனால் யாரும் வீட்டிற்குத் திரும்ப விரும்பவில்லை.",
    "he": "אתמול בערב הלכנו לנמל הישן וישבנו שם שעה ארוכה. היה קר, אבל אף אחד לא רצה לחזור הביתה.",
    "vi": "Tối hôm qua chúng tôi đi xuống bến cảng cũ. Trời lạnh nhưng không ai muốn về nhà.",
    "id": "Kemarin malam kami pergi ke pelabuhan tua. Cuaca dingin, tetapi tidak ada yang ingin pulang.",
}


@pytest.mark.parametrize("language", sorted(SENTENCES))
def test_sentences_of_any_language_are_prose(language):
    assert quality.judge(quality.finish(quality.chunk_state(SENTENCES[language]))) == "prose"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("ekmek\nsüt\npeynir\nzeytin\nçay\nşeker", "list"),
        ("wallet node hash script weight block node profile vbyte weight scaled script key centroid cluster seed cluster shard dust median.", "junk"),
        ("old harbour, hot wallet, the salt road; seven boats, night market, lamp oil; two keys, blue door, the mill", "list"),
        ("We  went\tdown to  the old\tharbour and  it was so  cold\tthat no one  of us\thad a word  to say.", "prose"),
        ("k=2$ z&1(q* x^%a 9!f~ #@p o)w_ =e+ t5$ &&n ^r* d(4 h!~ @m% u#c =g+ b)_ y&7", "junk"),
    ],
)
def test_structure_decides(text, kind):
    assert quality.judge(quality.finish(quality.chunk_state(text))) == kind


def test_a_mark_within_a_line_is_none_at_a_seam():
    assert quality.chunk_state("- and so on it went", begin=False)[1][quality.LINE.index("marked")] == 0
    assert quality.chunk_state("- and so on it went")[1][quality.LINE.index("marked")] == 1


def test_common_words_stand_in_many_documents(spark):
    df = spark.createDataFrame([("the fee the fee the fee",), ("The cat",), ("a cat b1c the_x",), (None,)], "text string")
    assert quality.common_words(df, n=2) == ["cat", "the"]


def test_huge_texts_are_cut_and_short_ones_read_once(spark, stage):
    line = "It was late, and we had to find the way back to the old harbour in the dark.\n"
    rng = random.Random(5)
    long = "".join(f"{rng.randrange(10**6)} {line}" for _ in range(8000))
    df = spark.createDataFrame([(1, long), (2, line)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.text_statistics(df, stage, common=["the"]).collect()}
    want = quality.finish(quality.chunk_state(long, frozenset(["the"])))
    assert len(long) > 2 * quality.CHUNK and {k: got[1][k] for k in want} == want and got[2].n_lines == 1


def test_merging_is_associative_and_equals_the_whole():
    rng = random.Random(4)
    for text in TEXTS.values():
        w = text.split(" ")
        cut = sorted(rng.sample(range(1, len(w)), min(3, len(w) - 1)))
        parts = [" " * bool(i) + " ".join(w[a:b]) for i, (a, b) in enumerate(zip([0, *cut], [*cut, len(w)]))]
        states = [quality.chunk_state(p, begin=not i) for i, p in enumerate(parts)]
        left = states[0]
        for s in states[1:]:
            left = quality.merge_states(left, s)
        right = states[-1]
        for s in states[-2::-1]:
            right = quality.merge_states(s, right)
        assert left == right
        assert quality.finish(left) == quality.finish(quality.chunk_state(text))


def test_statistics_frame(spark, stage):
    rows = [(1, TEXTS["prose"]), (1, TEXTS["list"]), (2, ""), (3, None), (4, " \n "), (5, (TEXTS["prose"] + "\n") * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as kind", "3 as row")
    got = sorted(((r.doc_id, r.kind, r.n_words) for r in quality.text_statistics(df, stage).collect()), key=str)
    n = quality.finish(quality.chunk_state(TEXTS["prose"]))["n_words"]
    assert (1, "prose", n) in got and [g for g in got if g[0] in (2, 3, 4)] == [(2, None, 0), (3, None, 0), (4, None, 0)]
    assert (5, "junk", n * 3000) in got and sum(g[0] == 1 for g in got) == 2
    assert quality.text_statistics(df.where("false"), stage).count() == 0
