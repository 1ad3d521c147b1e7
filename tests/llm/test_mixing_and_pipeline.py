"""Budgets against a plain water-filling, and the pipeline's stages each on its own input."""

from fractions import Fraction

from weftline.llm import mixing


def fill(caps, weights, budget):
    """Shares by weight with caps, what is short passed on to the rest, repeated until nothing changes."""
    out, open_ = dict.fromkeys(caps, 0), {k for k in caps if weights[k] > 0}
    left = Fraction(budget)
    while open_ and left > 0:
        price = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if caps[k] <= weights[k] * price}
        if not full:
            return out | {k: weights[k] * price for k in open_}
        for k in full:
            out[k], left = caps[k], left - caps[k]
        open_ -= full
    return out


def test_budgets(spark):
    leaves = [("d0", "en", "a", 100), ("d0", "en", "b", 1000), ("d0", "de", "a", 10), ("d1", "en", "c", 50), ("d2", "fr", "e", 0), ("d9", "xx", "z", 400)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    weights = {"domain": {"d0": 5, "d1": 3, "d9": 0}, "lang": {"de": 4}, "source": {"b": 3}}
    w = lambda level, k: weights[level].get(k, 1)
    for total in (0, 7, 600, 2000, 10**6):
        got = {(r["domain"], r["lang"], r["source"]): r for r in mixing.budgets(df, total=total, epochs=2, weights=weights).collect()}
        cap = {(d, l, s): (2 * t if w("domain", d) else 0) for d, l, s, t in leaves}
        part = lambda pre: sum(c for k, c in cap.items() if k[: len(pre)] == pre)
        domains = sorted({k[0] for k in cap})
        b1 = fill({d: part((d,)) for d in domains}, {d: w("domain", d) for d in domains}, total)
        for d in domains:
            langs = {k[1] for k in cap if k[0] == d}
            b2 = fill({x: part((d, x)) for x in langs}, {x: w("lang", x) for x in langs}, b1[d])
            for x in langs:
                sources = {k[2] for k in cap if k[:2] == (d, x)}
                b3 = fill({s: cap[d, x, s] for s in sources}, {s: w("source", s) for s in sources}, b2[x])
                for s in sources:
                    row = got[d, x, s]
                    assert abs(row["budget"] - b3[s]) <= 12 and row["budget"] <= b3[s], (total, d, x, s, row["budget"], float(b3[s]))
                    assert row["epochs"] * row["tokens"] + row["rest"] == row["budget"] or row["tokens"] == 0


def test_selection_meets_the_budget(spark):
    rows = [(i, "w " * (i % 50), "en" if i % 3 else None, f"src{i % 5}" if i % 7 else None, i) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copies int")
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "copies"]
    plan = {(r["domain"], r["lang"], r["source"]): r for r in mixing.plan(mixing.narrow_rows(docs)).collect()}
    taken = {}
    for r in got.collect():
        leaf = (f"d{int((r['source'] or 'src0')[3:]) % 4}", r["lang"] or "(none)", r["source"] or "(none)")
        taken[leaf] = taken.get(leaf, 0) + len(r["text"].split()) * r["copies"]
    for leaf, p in plan.items():
        assert p["budget"] <= taken.get(leaf, 0) < p["budget"] + 50
    assert got.orderBy("doc_id").collect() == mixing.mix(docs.repartition(7)).orderBy("doc_id").collect()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as pipe

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(pipe.STAGES):
        out = pipe.table(stage(spark, docs, sf))
        assert out.columns == names if i < 4 else out.columns == [*names, "copies"]
        seen[name] = (docs, out)
        docs = out
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    before, after = seen["language"]
    assert len(ids(before) - ids(after)) <= 1
    before, after = seen["near_duplicates"]
    from weftline.llm import jaccard

    assert ids(before) - ids(after) == {r["id"] for r in jaccard.link(before)[1].collect()}
    before, after = seen["decontaminate"]
    from weftline.llm import decontaminate

    hit = decontaminate.find_matches(before, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert ids(before) - ids(after) == {r["row_key"] for r in hit.collect() if r["hit_from"]}
    before, after = seen["personal_data"]
    assert ids(before) == ids(after) and not after.where("text rlike '[0-9]{1,3}([.][0-9]{1,3}){3}|@mail'").count()
    assert not after.where("n_chars <> char_length(text)").count()
    assert pipe.run(spark, sf).count() == seen["mix"][1].count()


def test_unknown_languages_go(spark):
    import random

    from weftline.llm import language

    rng = random.Random(7)
    junk = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n))
    foreign = ["日本語の文章を書くことは楽しいです。今日は天気が良いので公園に行きました。", "Сегодня хорошая погода, поэтому мы пошли в парк и встретили друзей.", "Σήμερα ο καιρός είναι καλός και πήγαμε στο πάρκο", junk(8), junk(300), "x" * 400, " ".join("%08x" % rng.getrandbits(32) for _ in range(60))]
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        model = language.train(docs)
        assert docs.select("lang").distinct().count() == 4
        rows = spark.createDataFrame(list(enumerate(foreign)), "doc_id long, text string")
        assert [r["text"][:20] for r in language.keep_known(rows, model).collect()] == []
        assert docs.where("text is not null").count() - language.keep_known(docs, model).count() <= 1
