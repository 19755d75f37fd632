"""Operators with an exact answer against brute force: shared spans, look-alikes, representatives, leakage."""

import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import leakage, lookalike, representative, shared_spans
from corpusloom.llm.batches import by_size

RECORD = "rec_id long, text string"


def spans_by_hand(records, n):
    seen = {}
    for i, t in records:
        for s in range(len(t or "") - n + 1):
            seen.setdefault(t[s : s + n], set()).add(i)
    out = set()
    for i, t in records:
        covered = sorted({c for s in range(len(t or "") - n + 1) if len(seen[t[s : s + n]]) > 1 for c in range(s, s + n)})
        for k, c in enumerate(covered):
            if k == 0 or c != covered[k - 1] + 1:
                start = c
            if k == len(covered) - 1 or covered[k + 1] != c + 1:
                out.add((i, start, c + 1))
    return out


def test_shared_spans(spark):
    rng = random.Random(1)
    pieces = ["".join(rng.choice("abc研究😀") for _ in range(rng.randint(15, 60))) for _ in range(8)]
    records = [(i, "".join(rng.choice([*pieces, "xy", "z" * 30]) for _ in range(rng.randint(1, 5)))) for i in range(40)] + [(90, None), (91, ""), (92, "a" * 300), (93, "b" * 50 + "b" * 50), (1, None)]
    records = [r for r in records if r != (1, None)]
    frames = [spark.createDataFrame(records[a::4], RECORD) for a in range(4)]
    got = {tuple(r) for r in shared_spans.shared_spans(frames, 20, 10).collect()}
    assert got == spans_by_hand(records, 20)
    # the same, however the records arrive, and with the runs compacted on the way
    again = {tuple(r) for r in shared_spans.shared_spans([spark.createDataFrame(records[a::7], RECORD) for a in range(7)], 20, 10).collect()}
    assert again == got
    empty = spark.createDataFrame([], RECORD)
    assert shared_spans.shared_spans([empty, empty], 20, 10).count() == 0
    # a passage in a third of the records is found in each of them
    hot = [(i, ("passage of the many " * 3) + str(i)) for i in range(300)] + [(i, f"own text number {i} " * 4) for i in range(300, 900)]
    rows = shared_spans.shared_spans([spark.createDataFrame(hot, RECORD)], 40, 20).groupBy("rec_id").count().collect()
    assert {r.rec_id for r in rows} >= set(range(300))
    amount = {r.rec_id: r for r in shared_spans.shared_amount(shared_spans.shared_spans(frames, 20, 10), spark.createDataFrame(records, RECORD)).collect()}
    assert amount[90].shared_share == 0 and len(amount) == len(records)


def test_log_goes_on_in_another_session(spark, tmp_path):
    rng = random.Random(4)
    pieces = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(15, 60))) for _ in range(8)]
    records = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 5)))) for i in range(48)]
    path, sessions = tmp_path.as_uri() + "/log", [spark, spark.newSession(), spark.newSession()]
    for k in range(6):
        session = sessions[k % 3]
        log = shared_spans.FingerprintLog(session, path, 20, 10, fan_in=3, buckets=3)
        before = set(map(tuple, log.spans().collect()))
        new = log.append(session.createDataFrame(records[k::6], RECORD))
        assert len(log.runs) <= 3
        so_far = {tuple(r) for r in log.spans().collect()}
        assert so_far == spans_by_hand([r for j in range(k + 1) for r in records[j::6]], 20)
        assert k == 0 or {r.rec_id for r in new.collect()} >= {r for r, *_ in so_far - before}
    assert {p.name for p in (tmp_path / "log").iterdir() if p.is_dir()} == set(log.runs)
    # a batch that brings nothing changes nothing
    log.append(spark.createDataFrame([(900, None), (901, "short")], RECORD))
    assert {tuple(r) for r in log.spans().collect()} == so_far


@given(st.text(alphabet="ab", min_size=0, max_size=60), st.integers(1, 20))
@settings(max_examples=60, deadline=None)
def test_window_hashes(text, width):
    codes = np.array([ord(c) for c in text], dtype=np.uint32)
    got = shared_spans.window_hashes(codes, width, 3) if len(text) >= width else np.zeros(0)
    windows = [text[i : i + width] for i in range(len(text) - width + 1)]
    assert len(got) == len(windows)
    assert len(set(got.tolist())) == len(set(windows))


def test_by_size():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * 5, None, "b" * 20, "c", ""]})
    parts = list(by_size(iter([batch, batch.slice(0, 0)]), most=6))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()


def test_lookalikes(spark):
    base = "Result of café 12 量 fi"
    same = ["Ｒｅsult of café 12 量 fi", "Rеsult of café 12 量 fi", "Re​sult of café 12 量 ﬁ", "Result of café 12　量 fi"]
    other = ["result of café 12 量 fi", "Result of cafe 12 量 fi", "Result of café 1² 量 fi", "Result of café 12 重 fi", "", None]
    rows = [(i, t) for i, t in enumerate([base, *same, *other, base])]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("normal_form", F.lit("clash")).withColumn("text_id", F.lit(0))
    forms = lookalike.normalize_lookalikes(df, "id", "text")
    by_id = {r.text_id: r for r in forms.collect()}
    assert len({by_id[i].visual_key for i in range(5)}) == 1 and by_id[5].normal_form == by_id[0].normal_form and by_id[10].visual_key is None
    last = len(rows) - 1
    want = {(a, b) for a in range(5) for b in range(a + 1, 5)} | {(a, last) for a in range(1, 5)}
    assert {tuple(r) for r in lookalike.lookalike_pairs(forms).collect()} == want
    assert lookalike.lookalike_pairs(forms.limit(0)).count() == 0


FORMS = lookalike.Forms()


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_normal_form_is_stable(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    once, seen = FORMS.normal(text), FORMS.visual(text)
    assert FORMS.visual(seen) == seen
    assert once == FORMS.normal(unicodedata.normalize("NFC", text))
    # what looks the same is of one class: the check within classes loses nothing
    assert FORMS.normal(seen) == once


def test_every_character_keeps_its_class():
    for code in range(0x80, 0x20000):
        if not 0xD800 <= code < 0xE000 and (seen := FORMS.visual(chr(code))) != chr(code):
            assert FORMS.normal(chr(code)) == FORMS.normal(seen), hex(code)


def test_confusable_letters(spark):
    forms = lookalike.Forms(lookalike.confusable_letters(spark))
    for a, b in (("Ꭺpple", "Apple"), ("Ꮃord", "Word"), ("ꓐus", "Bus"), ("𝖺𝖻", "ab")):
        assert forms.visual(a) == forms.visual(b) and forms.normal(a) == forms.normal(b)
    for a, b in (("𝐚", "a"), ("ο", "σ"), ("1", "l"), ("0", "O")):
        assert forms.visual(a) != forms.visual(b)


def test_links_of_classes(spark):
    rows = [(1, "ab"), (2, "ａb"), (3, "ab"), (4, "AB"), (5, "xy"), (6, "xy"), (7, None)]
    forms = lookalike.normalize_lookalikes(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    got = {r.text_id: r.n_links for r in lookalike.class_links(lookalike.lookalike_classes(forms)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    # a large class is cut into parts and loses no pair
    many = spark.createDataFrame([(i, "ab" if i % 2 else "ａb") for i in range(40)], "id long, text string")
    assert lookalike.lookalike_pairs(lookalike.normalize_lookalikes(many, "id", "text"), cell=3).count() == 400


LIT = "rec_id long, doi string, abstract string, citation_count int, lit_source string, retrieved_at timestamp, group_id string"


def test_representative(spark):
    import datetime as dt

    day = [dt.datetime(2024, 1, d) for d in range(1, 9)]
    records = spark.createDataFrame(
        [
            (1, "https://doi.org/10.1234/AbC", "Whole text here. And more.", 5, "Crossref ", day[0], "clash"),
            (2, "pending", "Whole text here.", -1, "dblp", day[5], "clash"),
            (3, "10.1234/", "Whole text he…", 7, None, day[3], "clash"),
            (4, "10.1234/x", "N/A", None, "dblp", day[1], None),
            (5, "doi:10.1234/x", None, 3, "dblp", None, None),
            (6, None, None, None, None, None, None),
        ],
        LIT,
    )
    groups = spark.createDataFrame([(100, 1), (100, 2), (100, 3), (200, 4), (200, 5), (300, 6), (100, 1)], "group_id long, rec_id long")
    trust = spark.createDataFrame([("crossref", 1), ("dblp", 2)], "lit_source string, trust_rank int")
    values = representative.judged_values(records, groups, trust)
    got = {(r.group_id, r.field_name): r.rec_id for r in representative.sole_best(values).collect()}
    assert got == {(100, "doi"): 1, (100, "abstract"): 1, (100, "citation_count"): 3, (100, "lit_source"): 1, (200, "citation_count"): 5}
    rows = {r.group_id: r for r in representative.surviving_records(values).collect()}
    assert rows[100].doi == "10.1234/abc" and rows[100].abstract == "Whole text here. And more." and rows[300].doi is None and rows[200].n_records == 2
    assert representative.sole_best(representative.judged_values(records.limit(0), groups, trust)).count() == 0


def test_consensus(spark):
    values = [("s", "alpha beta gamma delta", 1.0)] * 3 + [("s", "alpha beta gamna delta", 3.5), ("s", "alpha beta", 1.0), ("t", "x", 1.0), (None, "y", 1.0), ("u", None, 1.0)]
    rows = {(r.slot, r.value): r for r in representative.consensus(spark.createDataFrame(values, "slot string, value string, weight double")).collect()}
    assert rows["s", "alpha beta"].is_cut and not rows["t", "x"].is_cut and len(rows) == 4
    assert rows["s", "alpha beta gamna delta"].distance == 0 and rows["s", "alpha beta gamma delta"].distance == 1
    # the existing value closest to a consensus that no value equals, from more values than one chunk holds
    words = "one two three four five six seven eight nine ten".split()
    made = [("m", " ".join(w if k != i else w + "x" for k, w in enumerate(words)), 1.0) for i in range(10)] + [("m", " ".join(words[:9]) + "y zz", 1.0)]
    for chunk in (2, 64):
        far = {r.value: r.distance for r in representative.consensus(spark.createDataFrame(made, "slot string, value string, weight double"), chunk).collect()}
        assert all(far[v] == 1 for _, v, _ in made[:10]) and far[made[-1][1]] > 1


def test_align():
    a = [str(k % 977) for k in range(2010)]
    for size in (1990, 2010):  # nothing changes with the length
        x, y = a[:size], a[:size]
        y = [*y[:5], "p", *y[6:900], "q", *y[901:1500], *y[1501:]]
        pairs = representative.align(x, y)
        assert len(pairs) == size - 1 and sum(x[i] == y[j] for i, j in pairs) == size - 3
    assert representative.align([], ["a"]) == [] and representative.align(["a"], ["a"]) == [(0, 0)]


@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
@settings(max_examples=80, deadline=None)
def test_align_is_best(a, b):
    best = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            best[i, j] = -(i + j) if not i or not j else max(best[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), best[i - 1, j] - 1, best[i, j - 1] - 1)
    for cells in (1 << 22, 6):  # held at once, or halved
        representative.CELLS, kept = cells, representative.CELLS
        pairs = representative.align(a, b)
        representative.CELLS = kept
        score = sum(2 if a[i] == b[j] else -1 for i, j in pairs) - (len(a) + len(b) - 2 * len(pairs))
        # equal ends are taken off first, which costs nothing in the best alignment
        assert pairs == sorted(set(pairs)) and score == best[len(a), len(b)]


def leaks_by_hand(docs, items, least):
    def letters(t):
        return "".join(c for ch in t or "" for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", ch).casefold()) if c.isalnum())

    out = {}
    for d, t in docs:
        s = letters(t)
        for i, x in items:
            v = letters(x)
            n = least(v)
            held = {c for k in range(len(v) - n + 1) if v[k : k + n] in s for c in range(k, k + n)}
            if held:
                out[d, i] = len(held)
    return out


def test_leakage(spark):
    rng = random.Random(5)
    items = [(i, " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) for _ in range(25))) for i in range(12)]
    items += [(i, "请阅读下文。" + "".join(rng.choice("甲乙丙丁戊己庚辛壬癸子丑") for _ in range(60))) for i in range(12, 20)] + [(30, ""), (31, None), (32, "short")]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            text = rng.choice(items[:20])[1]
            a = rng.randint(0, len(text) - 1)
            parts.append(text[a : a + rng.randint(5, 120)].upper().replace(" ", rng.choice([" ", "", "-", "　"])))
        docs.append((d, "**".join(parts)))
    docs += [(70, None), (71, ""), (72, docs[0][1]), (73, "。" * 50)]
    least = lambda v: 15 if sum("一" <= c <= "鿿" for c in v) * 2 >= len(v) else 25
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = leakage.leaked_items(a, b).collect()
    assert {(r.doc_id, r.item_id): r.leaked_letters for r in rows} == leaks_by_hand(docs, items, least)
    for r in rows[:20]:
        text = dict(docs)[r.doc_id]
        assert all(0 <= s.span_start < s.span_end <= len(text) for s in r.spans)
    assert leakage.leaked_items(a.limit(0), b).count() == 0 and leakage.leaked_items(a, b.limit(0)).count() == 0


@given(st.lists(st.integers(0, 4), min_size=1, max_size=60))
@settings(max_examples=80, deadline=None)
def test_fm_index(values):
    seq = np.array([*values, 0], dtype=np.int64)
    index = leakage.FMIndex(seq, 6)
    patterns = np.array([[a, b] for a in range(1, 5) for b in range(1, 5)], dtype=np.int64)
    hit, low, high = index.search(patterns)
    got = {tuple(patterns[h]): sorted(index.locate(np.arange(a, b)).tolist()) for h, a, b in zip(hit, low, high, strict=True)}
    want = {}
    for i in range(len(seq) - 1):
        if seq[i] and seq[i + 1]:
            want.setdefault((int(seq[i]), int(seq[i + 1])), []).append(i)
    assert {tuple(map(int, k)): v for k, v in got.items()} == want


def test_letter_table():
    letters, place = leakage.LetterTable().letters("Ａb，ﬁ é!")
    assert "".join(map(chr, letters)) == "abfie" and place.tolist() == [0, 1, 3, 3, 5]
    with pytest.raises(AttributeError):
        leakage.LetterTable().letters(None)


def test_no_table_of_confusable_letters_is_an_error():
    class Session:
        class _jvm:
            class com:
                class ibm:
                    class icu:
                        class text:
                            class SpoofChecker:
                                Builder = object()  # a class that is not there can't be called

    with pytest.raises(RuntimeError, match="ICU"):
        lookalike.confusable_letters(Session())
