"""Overlaps, near duplicates and defects of pair records against brute force and hand-made cases."""

import datetime
import random
import re

import numpy as np
import pytest

from litmusq.llm import chunking, cross_split, endings, minwise, near_duplicates, pair_defects, truncation
from litmusq.llm.languages import differs, language
from litmusq.plans import lineage

T = datetime.datetime(2025, 1, 1)
SCHEMA = "pair_id string, anchor string, positive string, negative string, split string, source string, ord bigint, ingested_at timestamp, rid string, chunk string"
WORDS = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("alo", "eri", "imu", "ota", "ul", "yne")]


def words(text):
    return set(re.findall(r"[^\W_]+", (text or "").lower()))


def likeness(a, b):
    a, b = words(a), words(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, share):
    out = []
    for w in t.split():
        if rng.random() < share:
            out.append(rng.choice(WORDS).upper() + ",")
        else:
            out.append(w)
    return "  ".join(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(120):
        a, p, n = text(rng, 12), text(rng, 50), text(rng, 40)
        out.append((f"P{i:03}", a, p, n, rng.choice(["train", " Train", "test", "held-out", "ADVERSARIAL"]), "s", i, T, "clash", "clash"))
        for k in range(rng.choice([0, 0, 1, 3])):
            share = rng.choice([0.0, 0.03, 0.08, 0.3])
            out.append((f"Q{i:03}{k}", a, edited(rng, p, share), edited(rng, n, share), rng.choice(["train", "test"]), None, 1000 + 10 * i + k, T, "x", "y"))
    out += [("N1", None, "a b", "c d", "train", None, 1, T, "", ""), ("N2", "", "", "", "test", None, 2, T, "", ""), ("N3", "x", None, "y", "test", None, 3, T, "", ""), ("N4", "-", "!", "?", None, None, 4, T, "", ""), (None, "x", "y", "z", "train", None, 5, T, "", "")]
    long = text(rng, 30_000)
    out += [("L1", "long one", long, long, "train", "s", 6, T, "", ""), ("L2", "long one", long + " more", long, "test", "s", 7, T, "", "")]
    return out + out[:5]


@pytest.fixture(scope="module")
def pairs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_cross_split_equals_brute_force(pairs, rows):
    side = lambda s: re.sub("[^a-z]", "", (s or "").lower())
    known = {r[0]: r for r in rows if r[0]}.values()
    train = [r for r in known if side(r[4]) == "train"]
    other = [r for r in known if side(r[4]) in ("test", "heldout", "adversarial")]
    want = {tuple(sorted((a[0], b[0]))) for a in train for b in other if all(likeness(a[i], b[i]) >= 0.7 for i in (1, 2, 3))}
    got = cross_split.found_pairs(cross_split.cross_split_overlaps(pairs)).collect()
    assert len(want) > 10 and {tuple(r) for r in got} == want and len(got) == len(want)


def test_cross_split_finds_reordered_and_evenly_edited_records(spark):
    rng = random.Random(11)
    rows, n = [], 0
    for i in range(60):
        fields = [rng.sample(WORDS, k) for k in (12, 50, 40)]
        rows.append((f"T{i:03}", *map(" ".join, fields), "train", "s", n, T, "", ""))
        for k in range(4):
            if k == 0:
                changed = [rng.sample(f, len(f)) for f in fields]
            elif k == 1:
                changed = [[w for j in range(0, len(f), 2) for w in reversed(f[j : j + 2])] for f in fields]
            else:
                step = 6 if k == 2 else 7
                changed = [[f"new{i}x{j}" if j % step == step - 1 else w for j, w in enumerate(f)] for f in fields]
            n += 1
            rows.append((f"E{i:03}{k}", *map(" ".join, changed), "test", "s", n, T, "", ""))
    train, other = [r for r in rows if r[4] == "train"], [r for r in rows if r[4] == "test"]
    want = {tuple(sorted((a[0], b[0]))) for a in train for b in other if all(likeness(a[i], b[i]) >= 0.7 for i in (1, 2, 3))}
    got = {tuple(r) for r in cross_split.found_pairs(cross_split.cross_split_overlaps(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert len(want) >= 200 and got == want


def test_cross_split_report_counts_every_evaluation_record(pairs):
    report = cross_split.overlap_report(pairs, cross_split.cross_split_overlaps(pairs)).collect()
    assert sum(r.records for r in report) == pairs.where("regexp_replace(lower(split), '[^a-z]', '') IN ('test', 'heldout', 'adversarial') AND pair_id IS NOT NULL").select("pair_id").distinct().count()
    assert all(r.overlapping <= r.records and r.links >= r.overlapping for r in report)


def test_near_duplicates_equal_brute_force(pairs, rows):
    known = list({r[0]: r for r in rows if r[0]}.values())
    want = {tuple(sorted((a[0], b[0]))) for i, a in enumerate(known) for b in known[:i] if likeness(a[2], b[2]) >= 0.7 and likeness(a[3], b[3]) >= 0.7}
    got = near_duplicates.near_duplicates(pairs).collect()
    assert len(want) > 10 and {tuple(r) for r in got} == want and len(got) == len(want)


def test_large_nodes_branch_again(spark):
    """A third of all records are near copies of one another, far more than a leaf holds."""
    rng = random.Random(1)
    p, n = text(rng, 60), text(rng, 60)
    rows = [(f"A{i:03}", "a", edited(rng, p, 0.02), edited(rng, n, 0.02), "train", "s", i, T, "", "") for i in range(90)] + [(f"B{i:03}", "a", text(rng, 60), text(rng, 60), "train", "s", 100 + i, T, "", "") for i in range(120)]
    want = {(a[0], b[0]) for i, b in enumerate(rows) for a in rows[:i] if likeness(a[2], b[2]) >= 0.7 and likeness(a[3], b[3]) >= 0.7}
    got = {tuple(r) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(want) > 3000 and got == want


def test_trees_meet_the_stated_recall():
    for depth in (1, 5, 7, 10):
        assert 1 - (1 - near_duplicates.meets(depth)) ** near_duplicates.trees_for(depth) >= near_duplicates.RECALL


def test_large_family_at_the_threshold(spark):
    """Several hundred versions of one record, about 0.7 to 0.75 like each other."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    fields = [[" ".join(f"u{i}x{j}" if rng.random() < 0.083 else w for j, w in enumerate(base)) for _ in range(2)] for i in range(300)]
    rows = [(f"A{i:03}", "a", p, n, "train", "s", i, T, "", "") for i, (p, n) in enumerate(fields)]
    sets = [(words(p), words(n)) for p, n in fields]
    alike = lambda a, b: len(a & b) / len(a | b) >= 0.7
    want = {(rows[i][0], rows[j][0]) for j in range(300) for i in range(j) if alike(sets[i][0], sets[j][0]) and alike(sets[i][1], sets[j][1])}
    got = {tuple(r) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(want) > 5000 and got <= want and len(got) >= 0.998 * len(want)


def written(spark, rows, query, folder, monkeypatch):
    """(bytes shuffled and written to tables, bytes of text) of a query over rows."""
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(folder / "rows"))
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    kept = lambda: sum(f.stat().st_size for f in (folder / "tables").rglob("*") if f.is_file())
    before = shuffled()
    monkeypatch.setattr(lineage, "shared_dir", lambda spark: f"file://{folder}/tables")
    query(spark.read.parquet(str(folder / "rows"))).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return shuffled() - before + kept(), sum(len(t) for r in rows for t in r[1:4])


def test_near_duplicates_write_little(spark, tmp_path, monkeypatch):
    """Every record and tree once wrote several rows; the disk of a large run was 20 times its input."""
    rng = random.Random(5)
    rows = [(f"A{i:04}", text(rng, 12), text(rng, 60), text(rng, 60), "train", "s", i, T, "", "") for i in range(3000)]
    done, size = written(spark, rows, near_duplicates.near_duplicates, tmp_path, monkeypatch)
    assert done < 5 * size, (done, size)


def test_overlaps_write_little(spark, tmp_path, monkeypatch):
    """Keys of two words once made fifty rows of a record, each joined with thousands of others."""
    rng = random.Random(8)
    rows = [(f"A{i:04}", text(rng, 12), text(rng, 60), text(rng, 60), rng.choice(["train", "test"]), "s", i, T, "", "") for i in range(3000)]
    done, size = written(spark, rows, cross_split.cross_split_overlaps, tmp_path, monkeypatch)
    assert done < 3 * size, (done, size)


def test_anchors_under_one_word_and_records_of_one_anchor(monkeypatch):
    """Every two entries under a word that may be alike, many anchors or one, whatever is compared at once."""
    rng = np.random.default_rng(4)
    for anchors, at_once in ((400, 1 << 20), (400, 50), (1, 64), (30, 7)):
        monkeypatch.setattr(cross_split, "AT_ONCE", at_once)
        e = np.zeros(500, cross_split.ENTRY)
        e["rid"], e["aid"], e["side"] = np.arange(500), rng.integers(0, anchors, 500), rng.integers(1, 4, 500)
        base = rng.integers(0, 1 << 63, 5).astype(np.uint64)
        for c in ("anchor_0", "positive_0", "positive_1", "negative_0", "negative_1"):
            e[c] = base[0] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
        for f in ("positive", "negative"):
            e[f"{f}_n"] = rng.integers(18, 26, 500)
        e["anchor_0"], e["anchor_n"] = e["anchor_0"][e["aid"]], 8 + e["aid"] % 9
        apart = lambda f, i, j: sum(int(x).bit_count() for x in (e[f"{f}_{k}"][i] ^ e[f"{f}_{k}"][j] for k in ((0,) if f == "anchor" else (0, 1))))
        may = lambda i, j: all(apart(f, i, j) * 17 <= (n := int(e[f"{f}_n"][i])) * 3 + (m := int(e[f"{f}_n"][j])) * 3 and min(n, m) * 10 >= max(n, m) * 7 for f in cross_split.FIELDS)
        want = {(i, j) for i in np.flatnonzero(e["side"] & 1).tolist() for j in np.flatnonzero(e["side"] & 2).tolist() if i != j and may(i, j)}
        a, b = cross_split._meet(0.7)(rng.permutation(np.concatenate((e, e[:50]))))
        assert want and set(zip(a.tolist(), b.tolist())) == want


def test_many_records_under_one_key_are_compared_in_squares(spark):
    """All records meet in most bands, more than are compared place by place."""
    rng = random.Random(6)
    p, n = text(rng, 60), text(rng, 60)
    rows = [(f"A{i:03}", "a", edited(rng, p, 0.01), edited(rng, n, 0.01), "train", "s", i, T, "", "") for i in range(200)]
    want = {(a[0], b[0]) for i, b in enumerate(rows) for a in rows[:i] if likeness(a[2], b[2]) >= 0.7 and likeness(a[3], b[3]) >= 0.7}
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(want) > 10_000 and {tuple(r) for r in got} == want and len(got) == len(want)


def test_links_have_a_row_per_record(pairs):
    rows = near_duplicates.near_duplicate_links(pairs).collect()
    assert len({r.pair_id for r in rows}) == len(rows)
    assert all(r.class_id <= r.pair_id and r.copies >= 1 for r in rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cross_split.cross_split_overlaps(none).count() == 0
    assert near_duplicates.near_duplicates(none).count() == 0
    assert pair_defects.found_defects(none).count() == 0


def test_chunks_cover_texts_and_move_only_near_edits():
    rng = random.Random(2)
    a = text(rng, 300).encode()
    owner, digest, length = chunking.chunk_batch([b"", a, a[:700] + b"an edit" + a[700:], b"x", a])
    total = lambda i: int(length[owner == i].sum())
    assert [total(i) for i in range(5)] == [0, len(a), len(a) + 7, 1, len(a)]
    one, two, again = (set(digest[owner == i].tolist()) for i in (1, 2, 4))
    assert one == again and len(one - two) <= 3
    alone = chunking.chunk_batch([a])
    assert set(alone[1].tolist()) == one


def test_minwise_agreement_estimates_likeness():
    rng = np.random.default_rng(0)
    base = rng.integers(-(2**63), 2**63, 100)
    other = np.concatenate((base[:80], rng.integers(-(2**63), 2**63, 20)))
    sig = minwise.signatures(np.concatenate((base, other)), np.array([0, 100, 200]), 512)
    assert abs((sig[0] == sig[1]).mean() - 80 / 120) < 0.07


@pytest.mark.parametrize(
    ("text", "anchor", "want"),
    [
        (None, "a b", ["empty"]), (" ​\n", "a", ["empty"]), ("[no answer]", "a", ["empty"]), ("n/a.", "a", ["empty"]), ("None", "a", ["empty"]), ("...", "a", ["empty"]),
        ("We sort mail from a phone!", "We sort mail from a phone.", ["copy"]), ("Answer: we sort mail from a phone", "We sort mail from a phone.", ["copy"]),
        ("We sort mail from a phone. We sort mail from a phone.", "We sort mail from a phone.", ["copy"]), ("We sort post from a phone.", "We sort mail from a phone.", ["copy"]),
        ("I'm sorry, but I can't write that for you.", "We sort mail.", ["refusal"]), ("Es tut mir leid, aber zu Listen kann ich nichts schreiben.", "Wir ordnen die Post und das Lager.", ["refusal"]),
        ("Je ne suis pas autorisé à répondre ici.", "Nous trions le courrier pour les équipes.", ["refusal"]), ("No puedo ayudar con eso.", "La oficina ordena el correo de los clientes.", ["refusal"]),
        ("I can't count the hours we lost on lists, says the desk, until each came with a date.", "We sort mail.", []), ('The note said "I cannot help with that" and the desk went on to sort it.', "We sort mail.", []),
        ("Die Prüferin ordnet die Post und das Lager mit der Liste für den Abend.", "The desk sorts the mail for the evening.", ["wrong_language"]), ("没有确认之前，系统不得发送送货单！", "The desk sorts mail.", ["wrong_language"]),
        ("The desk sorts mail with „die Post und das Lager der Stadt“ as its sign.", "The desk sorts the mail.", []), ('The desk sorts the "mail', "The desk is where it starts.", ["truncated"]),
        ("The desk sorts all of it.", None, []), ("", None, ["empty"]),
    ],
)
def test_rules_on_single_texts(text, anchor, want):
    assert pair_defects.look(text, anchor)[0] == want


def test_abrupt_ends_by_corpus_evidence(spark):
    whole = [(f"W{i}", "The desk opens.", f"The desk sorts the mail of room {i} before the morning call. A clerk checks each label with the note.", "The engine transforms every touchpoint of the day.", "train", "s", i, T, "", "") for i in range(40)]
    ends = {"C1": ("The desk sorts the mail of room 4 before the mor", True), "C2": ("The desk sorts the mail of room 4 before the", True), "C3": ("The desk sorts the mail of room 4 before the morning call", False), "C4": ("The desk sorts the mail of room 5 before the morning call…", False), "C5": ("A clerk checks each label with the…", True), "C6": ("A clerk checks each la-", True), "C7": ("A clerk checks each label with the note 🙂", False)}
    rows = whole + [(k, "The desk opens.", t, "The engine transforms every touchpoint of the day.", "train", "s", 100 + i, T, "", "") for i, (k, (t, _)) in enumerate(ends.items())]
    got = {r.pair_id for r in pair_defects.found_defects(spark.createDataFrame(rows, SCHEMA)).where("defect = 'truncated' AND field = 'positive'").collect()}
    assert got == {k for k, (_, cut) in ends.items() if cut}


def test_one_row_per_field(spark, pairs):
    rows = pair_defects.defects(pairs).collect()
    assert len(rows) == 2 * pairs.where("pair_id IS NOT NULL").select("pair_id").distinct().count()


def test_languages():
    assert [language(t) for t in ("the cat and the dog", "der Hund und die Katze", "le chat et les chiens", "el gato y los perros", "没有确认", "")] == ["en", "de", "fr", "es", "zh", None]
    assert not differs("anything", "")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": [1, {"b": "x"}]}', "whole"), ('{"a": [1, {"b": "x"}', "cut"), ('{"a": "x', "cut"), ("{'a': \"x\", b: [1,],}", "whole"), ('```json\n{"a": 1}\n```', "whole"), ('```json\n{"a": 1}', "cut"), ('{"a": "uses ``` inside"}', "whole"),
        ('{"a": 1}\n\n-- end of answer', "whole"), ('{"a": "b\n[stream closed]', "cut"), ('{"a": "b\\u00', "cut"), ("A whole sentence.", "whole"), ("A whole sentence.\n\n(end of stage 3)", "whole"), ("It ends without", "ask"), ("", "whole"), (None, "whole"), ("   ", "whole"),
        ('An open "quote', "cut"), ("It was said (see note", "cut"), ('{"a": "A stray \'}\' in it"}', "whole"),
    ],
)
def test_stored_values(text, want):
    assert truncation.look(text)[0] == want


def test_cut_values_by_length_and_words(spark):
    stored = "result_id bigint, source string, raw_response string, parse_error string, called_at timestamp, ingested_at timestamp"
    base = "The scorer ranks a text higher when it names a plan and then the owner."
    rows = [(i, "good", base + f" Note {i}." * (i % 7), "KeyError: 'target'" if i % 2 else None, T, T) for i in range(60)]
    rows += [(100 + i, "short", (base * 9)[: 200 + i % 3 * 0], None, T, T) for i in range(30)] + [(200 + i, "short", base + " Fine." * (i % 9), None, T, T) for i in range(30)]
    rows += [(300, "good", base[:-4], "KeyError: 'tar", T, T), (301, "good", base + " The scorer ranks a text higher when it", None, T, T), (302, None, '{"a": "b', None, T, T), (302, None, '{"a": "b', None, T, T), (303, "good", None, None, T, T)]
    got = {(r.result_id, r.field) for r in truncation.cut_values(spark.createDataFrame(rows, stored)).collect()}
    assert {(301, "raw_response"), (302, "raw_response")} <= got
    assert {(100 + i, "raw_response") for i in range(30)} <= got
    assert not {r for r in got if r[0] < 100 or 200 <= r[0] < 300}
    rates = truncation.cut_rates(spark.createDataFrame(rows, stored)).collect()
    assert {r.source for r in rates} == {"good", "short", None} and all(0 <= r.share <= 1 for r in rates)
    assert truncation.cut_values(spark.createDataFrame([], stored)).count() == 0


def test_marks_behind_long_runs():
    assert truncation.bare("It ends." + " " * 200_000 + "…" + "\n" * 100_000)[0] == "It ends."
    assert truncation.look("word " * 100_000 + "\n" * 100_000 + "Last.")[0] == "whole"
    assert pair_defects.look("x" * 500_000, "An anchor.")[0] == []


def test_many_long_records_are_cut_in_pieces(spark, monkeypatch):
    """Long texts of few different words: alike are all whose word sets are, whatever their order."""
    rng = random.Random(9)
    rows = [(f"T{i:02}", "a b c", text(rng, 400), text(rng, 300), "train", "s", i, T, "", "") for i in range(12)]
    rows += [("E" + r[0], r[1], edited(rng, r[2], 0.02), edited(rng, r[3], 0.02), "test", "s", 100 + i, T, "", "") for i, r in enumerate(rows)]
    want = {(b[0], a[0]) for a in rows[:12] for b in rows[12:] if all(likeness(a[i], b[i]) >= 0.7 for i in (1, 2, 3))}
    monkeypatch.setattr(cross_split, "PIECE", 5_000)
    found = cross_split.cross_split_overlaps(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.eval_id, r.train_id) for r in found} == want and len(found) == len(want) == 144
    same = [r.overlap for r in found if r.eval_id == "E" + r.train_id]
    assert min(same) > 0.5 > max(r.overlap for r in found if r.eval_id != "E" + r.train_id)


def test_chunks_of_any_length_weigh_what_they_are(spark):
    """A text in which no cut falls is one chunk; its length counts whole."""
    rng = random.Random(4)
    body = f"{text(rng, 40)} {'a' * 9_000} {text(rng, 40)}"
    rows = [("T", "a b", body, "one two", "train", "s", 1, T, "", ""), ("F", "a b", f"{body} {WORDS[0]}", "one two", "test", "s", 3, T, "", "")]
    got = [r.overlap for r in cross_split.cross_split_overlaps(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == 1 and 0.9 < got[0] < 1


def test_long_last_words_are_known(spark):
    """A last word of any length is looked up whole, and a cut inside it is a stump."""
    long = "pneumonoultramicroscopicsilicovolcanoconiosis"
    rows = [(f"W{i}", "The ward opens.", f"The ward of room {i} treats {long}.", f"Nobody in room {i} speaks of {long} at all.", "train", "s", i, T, "", "") for i in range(40)]
    rows += [("C1", "The ward opens.", f"The ward of room 4 treats {long[:33]}", "Nobody speaks at all.", "train", "s", 100, T, "", ""), ("C2", "The ward opens.", f"The ward of room 4 treats {long}", "Nobody speaks at all.", "train", "s", 101, T, "", "")]
    got = {(r.pair_id, r.field) for r in pair_defects.found_defects(spark.createDataFrame(rows, SCHEMA)).where("defect = 'truncated'").collect()}
    assert got == {("C1", "positive")}


def test_runs_and_prefixes_hash_alike_one_by_one_and_in_batches():
    tokens = ["the", "desk", "sorts", "all", "of", "it", "now"]
    hashes = np.array([endings._hash(t) for t in tokens], np.uint64)
    with np.errstate(over="ignore"):
        batch = [int(r[-1].view(np.int64)) for r in endings.run_hashes(hashes)]
    assert endings.tail_of(" ".join(tokens)).runs == batch and len(batch) == endings.RUN
    words = ["", "aé", "a", "漢字" * 3000, "aéb"]
    owner, length, keys = endings.prefix_hashes(words)
    seen = {}
    for i, n, k in zip(owner, length, keys):
        assert seen.setdefault(words[i][:n], k) == k
    assert len(set(seen.values())) == len(seen) == 6003
    assert [k is None for k in endings.word_keys([None, "x", ""]).to_pylist()] == [True, False, True]


@pytest.mark.parametrize("size", [20, 100, 300])
def test_refusals_of_any_length(size):
    anchor = "We sort mail from a phone and print the list at noon."
    more = "That would go beyond the rules that were set for talks of this kind and nobody would gain. " * (size // 17 + 1)
    assert pair_defects.look(f"I am sorry, but I cannot help with that. {more}", anchor)[0] == ["refusal"]
    assert pair_defects.look(f"{more}I am sorry, but I cannot help with that.", anchor)[0] == ["refusal"]
    assert pair_defects.look(f"We sort the mail from a phone, and at noon we print the list. {more}I cannot help with more.", anchor)[0] == []
    assert pair_defects.look(f'The note said "I cannot help with that. {more}" and so it was sorted.', anchor)[0] == []


@pytest.mark.parametrize("refusal", ["Ik kan je daar helaas niet mee helpen.", "Mi dispiace, non posso aiutarti.", "Desculpe, não posso ajudar com isso.", "Извините, я не могу помочь.", "抱歉，我无法回答这个问题。", "申し訳ありませんが、お答えできません。", "죄송하지만 도와드릴 수 없습니다.", "آسف، لا يمكنني المساعدة في ذلك.", "माफ़ कीजिए, मैं इसमें मदद नहीं कर सकता।", "ขออภัย ฉันไม่สามารถช่วยเรื่องนี้ได้"])
def test_refusals_in_more_languages(refusal):
    assert "refusal" in pair_defects.look(refusal, "We sort mail.")[0]


def test_open_quotation_before_a_stop():
    assert pair_defects.look('The desk said "all of it is sorted.', "It is where it starts.")[0] == ["truncated"]
