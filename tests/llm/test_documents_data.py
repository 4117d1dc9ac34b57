"""Tokens, leaks and sentences of documents."""

import base64
import random
from pathlib import Path

import pytest

from litmusq.llm import bpe, leakage, sentences

DOCS = "doc_id bigint, text string, lang string, ids string, item_id string"


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    path = Path(bpe.vocabulary_path())
    if not path.exists():
        pytest.skip("no vocabulary here")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in path.read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(spark, library):
    rng = random.Random(0)
    texts = [None, "", " ", "\n\n", "<|endoftext|> x", "it's we'll  don't", "ก" * 500, "a" * 3000, "ab" * 900, "日本語のテキスト。", "é 👩‍🔧", "x\ty\r\nz  ", "".join(rng.choice("abcde fgh,.\n") for _ in range(5000)), "word " * 4000, "a\x00b", "same", "same"]
    df = spark.createDataFrame([(i, t, "en", "clash", "clash") for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {r.doc_id: list(r.ids) for r in bpe.encode(df).collect()}
    assert got == {i: library.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert bpe.encode(df.limit(0)).count() == 0


def test_all_documents_of_the_smallest_tables(spark, tiny, library):
    df = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: library.encode_ordinary(r.text) if r.text else [] for r in df.collect()}
    assert {r.doc_id: list(r.ids) for r in bpe.encode(df).collect()} == want


WORDS = [f"{a}{b}{c}" for a in "bdgklmnprst" for b in "aeiou" for c in ("ral", "min", "sto")]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


@pytest.mark.parametrize("indexed", [leakage.INDEXED, 0])
def test_leaks_by_share_and_changes(spark, monkeypatch, indexed):
    """The index sent to the workers, and the join beyond its size, find the same."""
    monkeypatch.setattr(leakage, "INDEXED", indexed)
    rng = random.Random(5)
    items = {i: passage(rng, 40) for i in range(1, 6)}
    fill = lambda n=60: " ".join(passage(rng, n))
    changed = list(items[2])
    for i in (5, 15, 25, 35):
        changed[i] = "zzz"
    docs = {
        1: f"{fill()} {' '.join(items[1])} {fill()}",
        2: f"{fill()}. {' '.join(changed)}, {fill()}",
        3: f"{fill()} {' '.join(items[3][8:32])} {fill()}",  # three fifths
        4: f"{fill()} {' '.join(items[4][:14])} {fill()}",  # a third
        5: "<b>" + "</b>\n\n**".join(w.upper() for w in items[5]) + "**",
        6: None, 7: "", 8: fill(3000), 9: f"{' '.join(items[1][::2])} {fill()}",
        10: f"{fill(9000)} {' '.join(items[3])} {fill(9000)}",
    }
    d = spark.createDataFrame([(k, t, "en", None, "clash") for k, t in docs.items()], DOCS)
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(9, None), (10, ""), (11, "tiny text")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (5, 5), (10, 3)}
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


@pytest.mark.parametrize("size", [20, 60, 150, 300])
@pytest.mark.parametrize("kind", ["left out", "put in", "changed"])
def test_leaks_with_a_tenth_of_the_words_edited(spark, size, kind):
    """Edits add up to long shifts in long items; every edited copy is found."""
    rng = random.Random(size)
    items = [(i, " ".join(passage(rng, size))) for i in range(20)]
    edited = []
    for i, t in items:
        w = t.split()
        for at in sorted(rng.sample(range(size), size // 10), reverse=True):
            w[at : at + 1] = [] if kind == "left out" else [w[at], "qqqqzz"] if kind == "put in" else ["qqqqzz"]
        edited.append((100 + i, " ".join(passage(rng, 50) + w + passage(rng, 50)), "en", None, None))
    got = {tuple(r) for r in leakage.leaks(spark.createDataFrame(edited, DOCS), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(100 + i, i) for i, _ in items}


def test_phrases_of_many_items(spark, monkeypatch):
    """Items that share a long phrase, and documents that hold only it; leaving hot q-grams out of the join changes nothing."""
    rng = random.Random(6)
    phrase = " ".join(passage(rng, 9))
    items = [(i, " ".join(passage(rng, 12)) + " " + phrase + " " + " ".join(passage(rng, 12))) for i in range(20)]
    d = spark.createDataFrame([(100 + i, "x " + t + " y", "en", None, None) for i, t in items] + [(200 + i, f"{' '.join(passage(rng, 30))} {phrase} end", "en", None, None) for i in range(20)], DOCS)
    i = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(tuple, leakage.leaks(d, i).collect()))
    assert whole == [(100 + k, k) for k in range(20)]
    monkeypatch.setattr(leakage, "HOT", 3)
    assert sorted(map(tuple, leakage.leaks(d, i).collect())) == whole
    monkeypatch.setattr(leakage, "INDEXED", 0)
    assert sorted(map(tuple, leakage.leaks(d, i).collect())) == whole


def test_short_items(spark, monkeypatch):
    items = spark.createDataFrame([(1, "Go up."), (2, "Press the red key now"), (3, "北京 上海 广州"), (4, "?!"), (5, "ab")], "item_id bigint, text string")
    docs = {1: "Then go up, said the desk.", 2: "They go upward.", 3: "Please press the red key at once.", 4: "press key red the", 5: "来自北京 上海 广州的", 6: "在 北京，上海。广州 见", 7: "a b"}
    d = spark.createDataFrame([(k, t, "en", None, None) for k, t in docs.items()], DOCS)
    assert {tuple(r) for r in leakage.leaks(d, items).collect()} == {(1, 1), (3, 2), (6, 3)}
    monkeypatch.setattr(leakage, "INDEXED", 0)
    assert {tuple(r) for r in leakage.leaks(d, items).collect()} == {(1, 1), (3, 2), (6, 3)}


def cut(text, lang="en"):
    return [text[a:b] for a, b in sentences.segment(text, lang)]


@pytest.mark.parametrize(
    ("lang", "parts"),
    [
        ("en", ["Dr. Ann B. Lee read it on Jan. 3.", "It took 2.5 sec. on avg. and v1.2.3 failed!", "Really?!", "Yes."]),
        ("en", ["Some (e.g. the desk) waited... and went on.", "See Fig. 3.", "Nouns, etc.", "The end."]),
        ("en", ['"Where is it?" asked the lead.', 'He said: "No. Not again!" and left.', 'The note ends with "Ship it."', "Then all went."]),
        ("en", ["(The run was left out, see Fig. 8.)", "pairKit exports came.", "Use data.json or step2.yaml only."]),
        ("de", ["Am 3. März kam Dr. Ott z. B. zu spät.", "Das sind ca. 4,5 Punkte, d. h. wenig.", "„Klingt gut. Beweist nichts.“, schrieb er.", "Er fragte: „Wo?“", "Dann ging er."]),
        ("fr", ["« Où est-il ? » demanda M. Petit.", "Voir le no. 4 et la fig. 2.", "Pourquoi donc ?", "L'écart gagne env. 2 points, c.-à-d. peu."]),
        ("es", ["—¿Dónde está? —preguntó el jefe.", "¡No!", "¿Por qué?", "El Sr. Díaz leyó p. ej. las notas del núm. 3."]),
    ],
)
def test_sentences_with_spaces(lang, parts):
    assert cut(" ".join(parts), lang) == parts
    assert cut(" ".join(parts), None) == parts


@pytest.mark.parametrize(
    ("lang", "parts"),
    [
        ("zh", ["图书馆希望。", "真的吗？！", "他写道：“不错。什么也没有。”", "“在哪里？”会计问道。", "（见图3。）", "v1.2版只读a.json。"]),
        ("ja", ["査読者は「良い。だが違う。」と書きました。", "「どこ？」と聞いた。", "なぜですか？", "（図5を参照。）"]),
    ],
)
def test_sentences_without_spaces(lang, parts):
    assert cut("".join(parts), lang) == parts


def test_other_scripts():
    assert cut('डॉ. राम ने पृ. 5 देखा। "कहाँ है?" उसने पूछा। क्यों?', "hi") == ["डॉ. राम ने पृ. 5 देखा।", '"कहाँ है?" उसने पूछा।', "क्यों?"]
    assert cut("قرأ د. علي الصفحة. «أين؟» سأل المراجع. لماذا؟", "ar") == ["قرأ د. علي الصفحة.", "«أين؟» سأل المراجع.", "لماذا؟"]
    assert cut("ทีม Derna เก็บไว้ รอบนี้มี 59 คู่ ห้ามส่ง", "th") == ["ทีม Derna เก็บไว้", "รอบนี้มี 59 คู่", "ห้ามส่ง"] or cut("ห้ามส่ง ทำไมจึง", "th") == ["ห้ามส่ง", "ทำไมจึง"]


def test_layout():
    text = "# A head. With stop\n\nIt runs\non here. And\r\nends\n \n- one. two\n* three\n1. four\n\n  lost\xa0 \n\nlast"
    assert cut(text) == ["# A head. With stop", "It runs\non here.", "And\r\nends", "- one. two", "* three", "1. four", "lost", "last"]


@pytest.mark.parametrize("text", [None, "", " \n\t ", "　"])
def test_no_sentences(text):
    assert sentences.segment(text, "en") == []


def test_sentences_cover_every_character(spark, tiny):
    df = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang")
    texts = {r.doc_id: r.text for r in df.collect()}
    spans = {}
    for r in sentences.sentences(df).collect():
        spans.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos))
    for k, t in texts.items():
        parts = sorted(spans.get(k, []))
        assert all(a < b for a, b in parts) and all(x[1] <= y[0] for x, y in zip(parts, parts[1:]))
        assert "".join("".join(t[a:b].split()) for a, b in parts) == "".join((t or "").split())
        assert all(t[a:b] == t[a:b].strip() for a, b in parts)


@pytest.mark.parametrize("size", [10, 30, 300])
def test_quotations_of_any_length(size):
    inner = "It is all in. " * size
    for opened, closed in (('"', '"'), ("“", "”"), ("«", "»"), ("(", ")")):
        text = f"The lead says {opened}{inner}Yes{closed} and goes on. Then all leave."
        assert [text[a:b] for a, b in sentences.segment(text, "en")] == [text[:-16], "Then all leave."]


def test_words_of_any_length_before_a_stop():
    long = "x" * 50 + "-no"
    assert cut(f"It is {long}. Then all leave.") == [f"It is {long}.", "Then all leave."]
    assert cut("Er kam am" + " " * 40 + "3. März. Dann ging er.", "de")[0].endswith("März.")
    assert cut("It ends. " + "a" * 60 + "B goes on.") == ["It ends.", "a" * 60 + "B goes on."]


def test_very_long_texts():
    assert len(sentences.segment('"' + "It is “all in. " * 20_000, "en")) >= 1
    assert len(sentences.segment("This is it. " * 20_000, "en")) == 20_000
    assert sentences.segment("x" * 300_000, "en") == [(0, 300_000)]
    assert len(sentences.segment('"' * 5_000 + "a. B", "en")) >= 1
