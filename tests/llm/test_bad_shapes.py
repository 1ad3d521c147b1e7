"""Inputs of bad shapes: long runs, crafted words, sparse and repeated ids, tiny rows, many blocks, hot keys; and the added spans against a plain version."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import decontaminate, fingerprint, jaccard, language, mixing, pii, toxicity, warc
from weftline.llm import textblocks as tb
from weftline.llm.sieve import Sieve

SF = "/root/testdata/sf0.001"


def docs_table(spark, tmp_path, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_op2_long_digit_runs(spark, tmp_path):
    rng = random.Random(3)
    digits = "".join(rng.choice("0123456789") for _ in range(200_000))
    texts = [digits, " ".join(digits), "-".join(digits), digits + " 4111 1111 1111 1111", "+" + digits, "+1" + " (" * 100_000 + "2", "a." * 100_000 + "@b", ".".join("1" * 100_000), "x" * 200_000 + "1", ("ab1 " * 50_000)]
    folder = docs_table(spark, tmp_path, list(enumerate(texts)))
    got = {r["doc_id"]: r for r in pii.contract(spark, folder).collect()}
    # Each run is one match, of too many digits or too few; only the dotted numbers are something, four by four.
    for i in range(len(texts)):
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [0, 25_000 if i == 7 else 0, 0, 0], i
    assert all(r["n_spans"] >= sum(r[f"n_{k}"] for k in pii.KINDS) for r in got.values())
    assert len(pii.redact(spark.read.parquet(f"{folder}/documents.parquet")).collect()) == len(texts)


def plain_added(text, base, model):
    """The method on one text: generators, features, trees, and the likeliest of overlapping candidates."""
    found = []
    for kind, pattern in pii.PROPOSED:
        for m in re.finditer(pattern, text):
            a, b = m.start(), m.end() + (len(m[1]) if "(?=(" in pattern else 0)
            v = text[a:b]
            d = re.sub("[^0-9]", "", v)
            side = lambda c: 2 if re.search(r"[A-Za-z0-9_]", c) else 0 if c == "" or re.search(r"[\x20\n,;:()\[\]]", c) else 1
            lead = text[max(0, a - pii.CONTEXT_CHARS) : a]
            near = text[max(0, a - 6) : a] + "|" + text[b : b + 6]
            luhn = len(d) > 11 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            found.append((a, b, kind, (pii.ALL_KINDS.index(kind), len(d), b - a, b - a - len(re.sub("[^A-Za-z0-9]", "", v)), int(luhn), int(d[0]) if d else -1, int(bool(re.search(pii.CONTEXT[kind], lead))), side(text[a - 1 : a] if a else ""), side(text[b : b + 1]), int(bool(re.search(r"[0-9][\x20-]?\||\|[\x20-]?[0-9]", near))))))
    likely = []
    for a, b, kind, x in dict.fromkeys(found):
        p = 1 / (1 + np.exp(-(sum(pii._leaf(t, x) for t in model.trees) * model.slope + model.offset)))
        if p >= model.threshold[kind] and not any(s < b and a < e for s, e in base):
            likely.append((-round(p, 12), a, pii.ALL_KINDS.index(kind), kind, b))
    taken = []
    for _, a, _, kind, b in sorted(likely):
        if not any(s < b and a < e for s, e, _ in taken):
            taken.append((a, b, kind))
    return sorted(taken)


def test_op2_added_spans_against_a_plain_version(spark):
    model = pii.train(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = [(10**6 + i, t) for i, (t, *_) in enumerate(pii.labelled_templates(300, seed=5))]
    rows = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    n = 0
    for r in pii.with_spans(rows, model).collect():
        base = [(s["start"], s["end"]) for s in r["base_"]]
        got = sorted((s["start"], s["end"], s["kind"]) for s in r["added_"])
        assert got == plain_added(r["text"] or "", base, model), r["doc_id"]
        n += len(got)
    assert n > 100


def test_op2_measured_on_planted_text(spark):
    """Every kind that the corpus's texts have by plain patterns, and what the method adds beside it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pii.with_spans(docs, pii.train(spark)).collect()
    tokens = [(r, m) for r in got for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r["text"] or "")]
    found = sum(any(s["kind"] == "secret" and (s["start"], s["end"]) == m.span(1) for s in r["added_"]) for r, m in tokens)
    wrong = sum(s["kind"] == "secret" and not re.fullmatch("(?i)[0-9a-f]{40}", r["text"][s["start"] : s["end"]]) for r in got for s in r["added_"])
    assert len(tokens) > 10 and found >= 0.95 * len(tokens) and wrong == 0


def thue_morse(n, a, b):
    other, s = {a: b, b: a}, a
    for _ in range(n):
        s += "".join(other[c] for c in s)
    return s


def test_crafted_words_differ(spark):
    x, y = thue_morse(11, "a", "b"), thue_morse(11, "b", "a")
    words = tb.words_of(*tb.string_parts(pa.array([f"{x} {y} {x.upper()}", f"q {y}"], pa.large_string())), tb.SPACE_SPLIT)
    assert words.hash[0] != words.hash[1] and words.hash[0] == words.hash[2] and words.hash[1] == words.hash[4]
    docs = spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string")
    assert [(r["id"], r["component"]) for r in jaccard.link(docs)[1].collect()] == [(3, 1)]
    # Runs of words that such a sequence makes differ too.
    letters = {"a": "one", "b": "two"}
    a, b = (" ".join(letters[c] for c in thue_morse(10, *ab)) for ab in ("ab", "ba"))
    tests = decontaminate.TestSet([("i", a)])
    length = next(iter(decontaminate.match_block(*tb.string_parts(pa.array([b], pa.large_string())), tests)))[4]
    wa, wb = a.split(), b.split()
    best = max(n for n in (512, 768, 1023, 1024) if any(wb[i : i + n] == wa[j : j + n] for i in range(len(wb) - n + 1) for j in range(len(wa) - n + 1)))
    assert best <= length < 1024
    monkey = tb._EXACT_RUN
    try:
        tb._EXACT_RUN = 1  # the way of very long words
        again = tb.words_of(*tb.string_parts(pa.array([f"{x} {y} {x.upper()}", f"q {y}"], pa.large_string())), tb.SPACE_SPLIT)
    finally:
        tb._EXACT_RUN = monkey
    assert (again.hash == words.hash).all()


def test_op1_hot_shingles_equal_sets_and_blocks(spark, monkeypatch):
    rng = random.Random(9)
    base, other = [f"w{i}" for i in range(60)], [f"v{i}" for i in range(400)]
    rows = []
    for i in range(700):
        words = list(base)
        words[i % 60] = f"x{i % 120}"
        rows.append((i, " ".join(words)))  # one large group with many equal sets
    rows += [(i, " ".join(rng.choice(other) for _ in range(30))) for i in range(700, 900)]
    rows += [(900 + i, rows[750][1] + " end") for i in range(30)]
    rows += [(5, rows[800][1]), (None, rows[0][1])]
    rng.shuffle(rows)
    sets = {}
    for i, t in rows:
        w = t.split()
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)))
    parent = {i: i for i in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = [(i, s) for i, many in sets.items() if i is not None for s in many]
    for (i, a), (j, b) in itertools.combinations(keys, 2):
        if i != j and len(a & b) * 5 >= len(a | b) * 4:
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    expected = sorted((i, root(i)) for i in parent if root(i) != i)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = lambda: sorted((r["id"], r["component"]) for r in jaccard.link(df)[1].collect())
    assert got() == expected
    monkeypatch.setattr(jaccard, "TILE_ROWS", 50)
    monkeypatch.setattr(jaccard, "TILE_BYTES", 2000)
    monkeypatch.setattr(jaccard, "PAIRS", 500)
    assert got() == expected
    monkeypatch.setattr(jaccard, "FREQUENT", 2.0)  # no element counts as frequent
    assert got() == expected


def test_near_duplicates_judge_rows(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(40)) for p in "abc")
    rows = [(3, a, 0), (5, a, 1), (5, b, 2), (7, c, 3), (7, c, 4), (None, a, 5), (None, a, 6), (9, None, 7), (9, None, 8), (2, a + " z", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_ int").repartition(3)
    kept = [(r["doc_id"], r["row_"]) for r in jaccard.keep_first(df).collect()]
    ids = sorted((i, n) for i, n in kept if i is not None)
    assert [i for i, _ in ids] == [2, 5, 7, 9, 9] and (5, 2) in ids and sorted(n for i, n in kept if i is None) == [5, 6]
    unique = spark.createDataFrame([(1, a), (2, a), (3, b), (None, a)], "doc_id long, text string")
    assert sorted((r[0] or 0) for r in jaccard.keep_first(unique).collect()) == [0, 1, 3]


def test_sieve_lets_no_member_by(spark):
    ids = spark.range(0, 5000, 7)
    sieve = Sieve(ids, "id")
    rows = spark.range(5000).selectExpr("id as k", "cast(id as string) as t").unionByName(spark.createDataFrame([(None, "n")], "k long, t string"))
    inside = {r["k"] for r in sieve.rows(rows, "k", True).collect()}
    outside = {r["k"] for r in sieve.rows(rows, "k", False).collect()}
    assert set(range(0, 5000, 7)) <= inside and not inside & outside and len(inside | outside) == 5001 and None in outside and len(inside) < 1200


@pytest.mark.parametrize("ids", [[*range(2000), 10**15], [-(2**62), 5, 5, 5, 2**62], [7], [10**12 + i * 10**9 for i in range(300)]])
def test_op4_any_id_space(spark, tmp_path, ids):
    folder = docs_table(spark, tmp_path, [(i, f"text {n} of {i} and more words") for n, i in enumerate(ids)])
    order = sorted(enumerate(ids), key=lambda x: (x[1], f"text {x[0]} of {x[1]} and more words"))
    texts = [f"text {n} of {i} and more words" for n, i in order]
    import hashlib

    expected = []
    for k, (_, i) in enumerate(order):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        m = len(t) // 4
        expected.append((i, hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest()))
    got = fingerprint.contract(spark, folder)
    assert sorted((r["doc_id"], r["edited_sha256"]) for r in got.collect()) == sorted(expected)
    starts = fingerprint.range_starts(spark.createDataFrame([(i,) for i in ids], "row_key long"), 64)
    spread = spark.createDataFrame([(i,) for i in ids], "row_key long").groupBy(fingerprint.range_of(F.col("row_key"), starts)).count().agg(F.max("count")).first()[0]
    assert spread <= max(3, len(ids) // 20)


def test_op5_blocks_of_tiny_rows():
    offsets = np.arange(0, 10_001 * 3, 3)
    sizes = [b - a for a, b in tb.blocks(offsets, rows=language.BLOCK_ROWS)]
    assert sum(sizes) == 10_000 and max(sizes) == language.BLOCK_ROWS


def test_op6_tasks_follow_ranges(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"{i} " * 3000) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    folder = str(tmp_path / "warc")
    files = warc.write_archives(pages, folder)
    size = files.agg(F.sum("size")).first()[0]
    got = warc.read_archives(files, folder, split_bytes=-(-size // 9))
    assert got.rdd.getNumPartitions() >= 9 and got.count() == 60


def test_op7_many_rounds(spark, monkeypatch):
    docs, tests = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    cols = ("row_key", "n_words", "hit_from", "hit_to", "items", "longest")
    rows = lambda df: sorted(map(repr, df.select(*cols).collect()))
    one, kept = rows(decontaminate.find_matches(docs, tests)), decontaminate.remove_affected(docs, tests).count()
    monkeypatch.setattr(decontaminate, "BLOCKS_SENT", 3)
    monkeypatch.setattr(decontaminate, "HELD_BYTES", 50_000)
    assert rows(decontaminate.find_matches(docs, tests, limit=900)) == one
    assert decontaminate.remove_affected(docs, tests, limit=900).count() == kept < docs.count()


def test_op3_large_plans_meet_by_key(spark):
    rows = [(i if i % 50 else None, "w " * (i % 30), "en" if i % 3 else None, f"src{i % 5}" if i % 7 else None, i) for i in range(400)]
    docs = spark.createDataFrame(rows + rows[:9], "doc_id long, text string, lang string, source string, copies int")
    plan = mixing.table(mixing.plan(mixing.narrow_rows(docs)))
    few, many = (sorted(map(repr, mixing.take(docs, plan, mixing.leaf_of(), sent=n).collect())) for n in (1000, 0))
    assert few == many and len(few) > 100


def test_op10_folds_leave_held_out_rows_alone(spark):
    rows = [(i, ("bad words here " if i % 6 == 0 else "calm text there ") + f"w{i % 40} w{i % 7}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 6 == 0).cast("int").alias("toxic"))
    plain = toxicity.fold_quality(docs, labels)
    assert len(plain) == 3 and all(area > 0.95 for area, _ in plain)
    from weftline.llm import samples

    other = docs.withColumn("text", F.when(samples.held_out(F.col("doc_id")), F.lit("bad bad bad")).otherwise(F.col("text")))
    assert toxicity.fold_quality(other, labels) == plain
