"""The registered digests against brute force, on the smallest tables and on odd rows."""

import base64
import hashlib
import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

from weftline.llm import decontaminate, fingerprint, jaccard, language, mixing, pii, tokencount, toxicity, urlfilter, warc

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} at{i % 13}" for i in range(60_000))
TEXTS = [None, "", " \n\t ", "one", "One two THREE four", "a b c d e f g h", "a b c d e f g h", "A B c d e f g h!", "é ü 日本 ok", "😀", "12345 !!!", "x" * 5000, LONG, LONG + " end", "mail joe.x@mail.example.com or +1 (528) 555-3435 at 1.2.3.4", "7536784127813050 4845168114407329"]
LANGS = ["en", "de", None, "fr", "es"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables of odd rows: nulls, empties, long texts, repeats, a null id, and more columns with the names that operators use inside."""
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, LANGS[i % 5], None if i % 6 == 5 else f"src{i % 4}", 7, "x", i) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "a b c d e f g h", "en", "src1", 1, None, None), (9_000_000_000, "a b c d e f g z", "en", "web", 1, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, base_ string, row_key int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "b c d"), (2, None), (3, ""), (4, " ".join(f"word{i} at{i % 13}" for i in range(6))), (4, "b c d"), (None, "a"), (5, "q w e r t y u i o p a s d f")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 1), (3, 0, None), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "http://a.b/c", "x"), (2, None, "x"), (3, "no url", None), (4, "https://U@Big.Host.:80/é?q", ""), (4, "http://a.b/c", ""), (None, "http://x", "x"), (7, "http://h\r\nX: y/", "z" * 50_000)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark", "labels", "pages"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


def docs_of(spark, folder):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def lower(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def sorted_rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


CONTRACTS = [jaccard, pii, mixing, fingerprint, language, warc, decontaminate, urlfilter, tokencount, toxicity]


@pytest.mark.parametrize("module", CONTRACTS, ids=lambda m: m.__name__.rpartition(".")[2])
def test_empty_tables(spark, empty, module):
    assert module.contract(spark, empty).collect() == []


@pytest.mark.parametrize("folder", [SF, "odd"])
def test_op1(spark, odd, folder):
    folder = odd if folder == "odd" else folder
    docs = docs_of(spark, folder)
    sets = {}
    for i, t in docs:
        w = [lower(x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[i, t] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations([((k[0], s)) for k, s in sets.items() if k[0] is not None and s], 2):
        if 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    expected = sorted(((i, len(sets[i, t]), None if i is None else root(i)) for i, t in docs), key=repr)
    assert sorted_rows(jaccard.contract(spark, folder), "doc_id", "n_shingles", "component_id") == expected


def test_op1_large_classes_are_dealt_into_tiles(spark, tmp_path, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        words[i] = f"x{i}"
        rows.append((i, " ".join(words[: 60 - i % 4])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    plain = sorted_rows(jaccard.link(df)[1], "id", "component")
    monkeypatch.setattr(jaccard, "TILE_ROWS", 7)
    monkeypatch.setattr(jaccard, "TILE_SHINGLES", 300)
    assert sorted_rows(jaccard.link(df)[1], "id", "component") == plain and len(plain) > 50


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


@pytest.mark.parametrize("folder", [SF, "odd"])
def test_op2(spark, odd, folder):
    folder = odd if folder == "odd" else folder
    expected = []
    for i, t in docs_of(spark, folder):
        spans = sorted((m.start(), n, k, m.end()) for n, (k, p) in enumerate(PATTERNS) for m in re.finditer(p, t or "") if valid(k, m[0]))
        expected.append((i, *(sum(s[2] == k for s in spans) for k, _ in PATTERNS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()))
    got = pii.contract(spark, folder)
    assert sorted_rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(expected, key=repr)


def test_op2_method_adds_and_redacts(spark):
    rows = spark.createDataFrame([(1, "7536784127813050 4845168114407329 x", "keep", 3), (2, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1", None, 4), (3, None, None, 5)], "doc_id long, text string, base_ string, added_ int")
    got = {r["doc_id"]: r for r in pii.redact(rows).collect()}
    assert got[1]["text"] == "<CARD> <CARD> x" and got[1]["base_"] == "keep" and got[3]["text"] is None and got[3]["added_"] == 5
    assert got[2]["text"] == "<EMAIL><EMAIL> <IP>.<IP> 999.1.1.1"
    model = pii.train(spark)
    assert all(model.threshold[k] <= 0.99 for k in ("email", "card", "phone"))


def test_op2_candidates_overlap(spark):
    texts = ["paid 2024 4111 1111 1111 1111 today", "4111-1111-1111-1111-5500-0000-0000-0004", "ref 7788 5500 0000 0000 0004 2031", "tel 0301 01234 56789", "é a(at)b.c (at) d.com x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [texts[r["doc_id"]][c["start"] : c["end"]] for c in r["c"]] for r in rows.select("doc_id", pii.candidates(F.col("text")).alias("c")).collect()}
    assert got[0] == ["2024 4111 1111 1111", "4111 1111 1111 1111"] and len(got[1]) == 5 and "5500 0000 0000 0004" in got[2]
    assert got[3] == ["0301 01234", "01234 56789"] and got[4] == ["a(at)b.c", "b.c (at) d.com"]
    done = [r["text"] for r in pii.redact(rows).orderBy("doc_id").collect()]
    assert done[:3] == ["paid 2024 <CARD> today", "<CARD>-<CARD>", "ref 7788 <CARD> 2031"]


@pytest.mark.parametrize("folder", [SF, "odd"])
def test_op4(spark, odd, folder):
    folder = odd if folder == "odd" else folder
    docs = sorted(((i, t or "") for i, t in docs_of(spark, folder)), key=lambda d: (d[0] is None, d))
    placed = [d for d in docs if d[0] is not None]
    shingles = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})(re.findall(r"[^\x20\x09-\x0D]+", t.lower()))
    expected, near = [], {}
    for k, (i, t) in enumerate(docs):
        after = placed[(k + 1) % len(placed)][1] if i is not None else t
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
        a, b, c = shingles(t), shingles(edited), shingles(after)
        near[i, t] = [len(a & x) / len(a | x) if a | x else 1.0 for x in (b, c)]
    got = fingerprint.contract(spark, folder)
    assert sorted_rows(got, "doc_id", "n_chars", "edited_sha256") == sorted(expected, key=repr)
    texts = {}
    for r, t in ((r, t) for r in got.collect() for i, t in docs if i == r["doc_id"] and len(t) == r["n_chars"]):
        if folder == SF:
            assert abs(r["near_edited"] - near[r["doc_id"], t][0]) < 0.2 and abs(r["near_next"] - near[r["doc_id"], t][1]) < 0.2
        assert texts.setdefault(t, r["fingerprint"]) == r["fingerprint"]


def test_op4_sketches_merge(spark):
    words = [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([("k", " ".join(words[:2000])), ("k", " ".join(words[1000:]))], "k string, t string")
    df = df.select("k", fingerprint.sketch(F.col("t")).alias("s"))
    whole = spark.createDataFrame([(" ".join(words),)], "t string").select(fingerprint.sketch(F.col("t")).alias("s"), fingerprint.distinct_count(fingerprint.sketch(F.col("t"))).alias("n")).first()
    assert fingerprint.merge_parts(df, ["k"], "s").first()["s"] == whole["s"] and abs(whole["n"] - 2996) < 900
    a, b = (r["s"] for r in df.collect())
    pair = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(fingerprint.containment(F.col("a"), F.col("b")).alias("c"), fingerprint.resemblance(F.col("a"), F.col("b")).alias("r")).first()
    assert abs(pair["c"] - 0.5) < 0.2 and abs(pair["r"] - 1 / 3) < 0.15


def test_op4_empty_parts_merge(spark):
    df = spark.createDataFrame([("a", None), ("a", "  "), ("b", ""), ("b", "one two"), (None, "")], "k string, t string").select("k", fingerprint.sketch(F.col("t")).alias("s"))
    got = {r["k"]: r["s"] for r in fingerprint.merge_parts(df.union(spark.createDataFrame([("b", None), ("n", None)], "k string, s array<long>")), ["k"], "s").collect()}
    assert got["a"] == got["n"] == got[None] == [] and len(got["b"]) == 1 and len(got) == 4


def test_op5(spark, odd):
    got = language.contract(spark, "/root/testdata/sf0.01")
    truth = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in got.collect() if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows) and len(rows) > 150
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) / len(rows) > 0.97
    rows = language.contract(spark, odd).collect()
    assert len(rows) == len(TEXTS) + 3 and all(0 <= r["score"] <= 1 for r in rows)
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert {0, 1, 2, 9, 10} <= und and 8 not in und


@pytest.mark.parametrize("folder", [SF, "odd"])
def test_op6(spark, odd, folder):
    folder = odd if folder == "odd" else folder
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html", "url").collect()]
    best = {}
    for i, h, _ in rows:
        if i is not None:
            best[h or ""] = max(i, best.get(h or "", i))
    expected = []
    for i, h, u in rows:
        body = (h or "").encode()
        of = best.get(h or "")
        copy = i is not None and i < of
        expected.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if copy else "response", of if copy else None, u))
    assert sorted_rows(warc.contract(spark, folder), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url") == sorted(expected, key=repr)


def test_op6_ranges_and_damage(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "\x1f\x8b\x08 <p>" * (i % 40)) for i in range(300)], "page_id long, url string, html string")
    folder = str(tmp_path / "warc")
    files = warc.write_archives(pages, folder, dedup_from=1 << 30)
    for size in (1 << 24, 4096, 333):
        got = warc.read_archives(files, folder, split_bytes=size)
        assert sorted((r["page_id"], r["payload"].decode()) for r in got.collect()) == sorted((r["page_id"], r["html"]) for r in pages.collect())
    assert warc.list_archives(spark, folder).count() == files.count()
    name = files.first()["path"]
    data = (tmp_path / "warc" / name).read_bytes()
    (tmp_path / "warc" / name).write_bytes(data[: len(data) - 20])
    with pytest.raises(Exception, match="corrupt or cut off"):
        warc.read_archives(warc.list_archives(spark, folder), folder).collect()
    # A record within a record's payload is not taken for one.
    inner = warc.encode_record(1, None, b"p", 1, base64.b32encode(hashlib.sha1(b"p").digest()).decode(), None, level=0)
    outer = warc.encode_record(2, None, b"q" * 50 + inner + b"r" * 50, 100 + len(inner), base64.b32encode(hashlib.sha1(b"q" * 50 + inner + b"r" * 50).digest()).decode(), None, level=0)
    import io

    assert [m[0] for at in range(0, len(outer), 64) for m in warc.members(io.BytesIO(outer), len(outer), at, min(at + 64, len(outer)))] == [0]


def brute_op7(docs, items):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = {}
    for i, t in items:
        w = find(lower(t or ""))
        for k in range(max(1, len(w) - 9)) if w and i is not None else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, ids = find(lower(t or "")), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    ids |= found
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("folder", [SF, "odd"])
def test_op7(spark, odd, folder):
    folder = odd if folder == "odd" else folder
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    expected = brute_op7(docs_of(spark, folder), items)
    assert sorted_rows(decontaminate.contract(spark, folder), *cols) == expected
    # In many blocks of items the result is the same.
    docs, tests = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    few = decontaminate.find_matches(docs, tests.limit(9), limit=100)
    one = decontaminate.find_matches(docs, tests.limit(9))
    shown = ("row_key", "n_words", "hit_from", "hit_to", "items", "longest")
    assert sorted_rows(few, *shown) == sorted_rows(one, *shown)


def test_op7_longest_match_and_removal(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "x y " + " ".join(f"w{i}" for i in range(5, 25)) + " z", 1), (2, "w3 w4 w5 q", 2), (3, None, 3)], "doc_id long, text string, longest int")
    tests = spark.createDataFrame([("i", item)], "item_id string, text string")
    got = {r["row_key"]: r for r in decontaminate.find_matches(docs, tests).collect()}
    assert (got[1]["longest"], got[1]["longest_item"], got[1]["longest_at"]) == (20, "i", 2) and got[2]["longest"] == 3 and got[3]["longest"] == 0
    assert sorted(r["doc_id"] for r in decontaminate.remove_affected(docs, tests).collect()) == [2, 3]


def test_op7_longest_match_of_every_copy(spark):
    passage = " ".join(f"w{i}" for i in range(5, 25))
    docs = spark.createDataFrame([(i, "x " * i + passage + " z") for i in range(6)], "doc_id long, text string").coalesce(1)
    tests = spark.createDataFrame([("i", " ".join(f"w{i}" for i in range(30)))], "item_id string, text string")
    got = decontaminate.find_matches(docs, tests)
    assert sorted_rows(got, "row_key", "longest", "longest_item", "longest_at") == [(i, 20, "i", i) for i in range(6)]


def test_op7_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a x c d"), (3, "q w e")], "doc_id long, text string")
    tests = spark.createDataFrame([(None, "b c"), (7, "q w e")], "item_id long, text string")
    for limit in (1, 1 << 20):
        got = sorted_rows(decontaminate.find_matches(docs, tests, limit=limit), "row_key", "hit_from", "hit_to", "items")
        assert got == [(1, [1], [3], []), (2, [], [], []), (3, [0], [3], ["7"])]
    assert [r["doc_id"] for r in decontaminate.remove_affected(docs, tests).collect()] == [2]


def test_op7_longest_match_of_any_length():
    import random

    import pyarrow as pa

    from weftline.llm import textblocks as tb

    rng = random.Random(5)
    some = [f"w{i}" for i in range(6)]
    long_ = [rng.choice(some) for _ in range(500)]
    items = [("a", long_[:90]), ("b", long_), ("c", [*long_[100:300], "y", *long_[:20]]), ("d", ["r"] * 150), ("e", ["s", "t", "u", "v", *["q"] * 9])]
    docs = [["p", *long_, "p"], long_[100:310], ["r"] * 200, [*long_[20:140], "zz", *long_[140:205]], ["zz", "s", "t", "zz"], ["zz", "t", "s"], ["zz"], [], [*long_[:70], *long_[50:130]], [rng.choice(some) for _ in range(300)]]
    tests = decontaminate.TestSet([(i, " ".join(w)) for i, w in items])
    offsets, data = tb.string_parts(pa.array([" ".join(d) for d in docs], pa.large_string()))
    texts = {i: " " + " ".join(w) + " " for i, w in items}
    for doc, row in zip(docs, decontaminate.match_block(offsets, data, tests)):
        length, item, at = row[4:]
        is_in = lambda k, n: [i for i, t in texts.items() if " " + " ".join(doc[k : k + n]) + " " in t]
        assert not any(is_in(k, length + 1) for k in range(len(doc) - length)), (doc[:5], length)
        if length:
            assert item in is_in(at, length) and at == next(k for k in range(len(doc)) if is_in(k, length) and k + length <= len(doc))
        else:
            assert item is None and at is None
    got = [r[4] for r in decontaminate.match_block(offsets, data, tests)]
    assert got[:8] == [500, 210, 150, 120, 2, 1, 0, 0]


def test_op8_intervals(spark):
    log = spark.createDataFrame([("domain:b.c", "x", "add", 10), ("domain:b.c", "x", "remove", 20), ("domain:b.c", "x", "add", 20), ("host:a.b.c", "y", "add", 15), ("prefix:a.b.c/p", "z", "add", 5), ("domain:b.c", "x", "add", 30), (None, "x", "add", 1)], "entry string, category string, action string, at int")
    caps = spark.createDataFrame([(1, "http://A.b.c/q", 9), (2, "http://a.b.c./q", 10), (3, "http://u@a.b.c:8/p/q?x", 19), (4, "http://x.b.c", 20), (5, "http://b.c/", 30), (6, "http://xb.c/", 30), (7, None, 30), (8, "http://a.b.c/pp", 40)], "page_id long, url string, fetched int")
    got = sorted_rows(urlfilter.match(caps, log), "page_id", "entry")
    assert got == [(2, "domain:b.c"), (3, "domain:b.c"), (3, "host:a.b.c"), (3, "prefix:a.b.c/p"), (5, "domain:b.c"), (8, "domain:b.c"), (8, "host:a.b.c")]
    assert [r[0] for r in urlfilter.keep_unlisted(caps, log).orderBy("page_id").collect()] == [1, 4, 6, 7]
    assert urlfilter.keep_unlisted(caps, log.limit(0)).count() == 8


def test_op8_deep_entries(spark):
    path, host = "/".join(f"p{i}" for i in range(30)), ".".join(f"h{i}" for i in range(12))
    log = spark.createDataFrame([(f"prefix:a.b/{path}", "x", "add", 1), (f"prefix:a.b/{path[:26]}", "x", "add", 5), (f"domain:{host}", "y", "add", 1)], "entry string, category string, action string, at int")
    caps = spark.createDataFrame([(1, f"http://a.b/{path}/q?x", 3), (2, f"http://a.b//{path}", 5), (3, f"http://a.b/{path[:-1]}", 3), (4, f"http://z.{host}/", 3), (5, f"http://{host[1:]}/", 3)], "page_id long, url string, fetched int")
    assert sorted_rows(urlfilter.match(caps, log), "page_id", "entry") == [(1, f"prefix:a.b/{path}"), (2, f"prefix:a.b/{path[:26]}"), (2, f"prefix:a.b/{path}"), (4, f"domain:{host}")]
    assert [r[0] for r in urlfilter.keep_unlisted(caps, log).orderBy("page_id").collect()] == [3, 5]


@pytest.mark.parametrize("folder", [SF, "odd"])
def test_op9(spark, odd, folder):
    import public_tokenizers

    folder = odd if folder == "odd" else folder
    tokenizer = tokencount.load(str(public_tokenizers.path(tokencount.TOKENIZER)))
    expected = []
    for i, t in docs_of(spark, folder):
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        expected.append((i, len((t or "").encode()), n, n > 1024))
    assert sorted_rows(tokencount.contract(spark, folder), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(expected, key=repr)


def test_op9_odd_characters():
    import public_tokenizers

    path = str(public_tokenizers.path(tokencount.TOKENIZER))
    counter, tokenizer = tokencount.TextCounter(path, tokencount.prove_whole(path)), tokencount.load(path)
    texts = ["<|endoftext|> a <|endoftext|>", "a​b  \n\n x", "  '''s don't 'S 're", "\x1c a\x85b", "日本語 テスト", "a\xa0b", "x²y½z", "_a__b 1_2", "café naïve €5–6…", "\t\t x \r\n\r\n", " " * 40, "é" * 3000, "ǅ ŉ ß"]
    for t in texts:
        assert counter(t) == len(tokenizer.encode(t, add_special_tokens=False).ids), t


def test_op10(spark, odd):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in toxicity.contract(spark, sf).collect()}
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect()}
    rows = [(got[i]["score"], y) for i, y in labels.items() if got[i]["held_out"]]
    pos, neg = sorted(s for s, y in rows if y), sorted(s for s, y in rows if not y)
    better = sum(sum(n < p for n in neg) + 0.5 * sum(n == p for n in neg) for p in pos) / (len(pos) * len(neg))
    assert better > 0.93 and sum(s >= 0.3 for s in neg) / len(neg) < 0.03
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.contract(spark, odd).count() == len(TEXTS) + 3
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(spark.read.parquet(f"{odd}/documents.parquet"), none).column is None
