"""Personal data by candidate gradient boosting, with DataFrame functions only.

Method.  Base patterns (e-mail address, IP address, payment card, telephone number with
country code) give base spans, which always stay.  High-recall generators propose further
candidate spans, which may overlap each other and failed base matches: digit groups inside
longer digit runs, national telephone numbers, spelled-out e-mail addresses, and long
strings of letters and digits that may be keys or tokens.  Features of a
candidate's format (digits, separators, checksum, leading digit) and context (words before
it, characters beside it) go into boosted trees, whose calibrated probability must reach the
kind's threshold; of overlapping candidates the likeliest wins, and none may overlap a base
span.

The trees are trained here, with numpy on the driver, from a bounded set of labelled
templates (``TEMPLATES`` texts from a seeded generator; half of them fit the trees, half
calibrate probabilities and set thresholds at the wanted precision).  Training and the corpus
use the same feature expressions, and the trained model is an expression of nested cases, so
every document is handled inside the JVM, whole, without a shuffle.

Defined cases: a null text is empty, has no spans and stays null when redacted; repeated
rows are handled alike; columns of any name may stand beside the text; overlapping base
spans of different kinds all stay and are redacted as one; runs of digits of any length are
one match (no pattern recurses for each character); other columns stay as they are.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans: those of the base, and secrets, which have no base pattern.
ALL_KINDS = (*KINDS, "secret")
#: Fixed patterns of the base spans, in the order of KINDS.  The first two are written so that a failed match is not tried again from each character of the same run; they match the same spans; of runs of digits only those of 14 and more are matched, since the others never count, and possessively: a loop that may give back would recurse for each digit.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators of further candidates: kind and pattern.  Where candidates may overlap, a match takes in only the first group, and the lookahead's group 1 has the rest, so that the next group may begin a candidate too.
PROPOSED = (
    ("card", r"(?<![0-9])[0-9]{4}(?=(([\x20-]?)[0-9]{4}\2[0-9]{4}\2[0-9]{2,7})(?![0-9]))"),
    ("card", r"(?<![0-9])[0-9]{14,19}(?![0-9])"),
    ("phone", r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9])0[0-9]{2,4}(?=([\x20/-][0-9]{5,8})(?![0-9]))"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?=(\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]{1,63}){1,4})(?![A-Za-z0-9-]))"),
    ("secret", r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{16,128}(?![A-Za-z0-9_+/=-])"),
)
#: What any match of a generator's has in it, where it is much cheaper to look for: a string of letters and digits has a digit beside another sign.
_MIXED = r"[0-9][A-Za-z_+/-]|[A-Za-z_+/-][0-9]"
_NEEDS = {"email": r"[(\[]at[)\]]", "secret": _MIXED}
CONTEXT = {
    "email": r"(?i)(mail|contact|write|kontakt|correo|courriel)",
    "card": r"(?i)(card|visa|credit|karte|carte|tarjeta|payment|zahlung)",
    "phone": r"(?i)(phone|tel|call|mobile|cell|fax|anruf|handy|appel|llam)",
    "secret": r"(?i)(token|secret|key|passw|pwd|credential|bearer|auth)[\w\x20\"':=-]{0,12}$",
}
CONTEXT_CHARS = 40
FEATURES = ("kind", "digits", "length", "separators", "luhn", "first", "context", "before", "after", "in_run")
TEMPLATES, TREES, DEPTH, RATE = 2400, 24, 3, 0.3
PRECISION = 0.97
SPAN = "struct<start:int,end:int,value:string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Matches whose places are summed at once; blocks of so many are then moved together, so a text with very many matches costs little more than in proportion.
_BLOCK = 256


def find(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as (start, end, value), in code points, end exclusive."""
    pieces = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("m"), F.char_length(gap).alias("gap"), F.char_length(m).alias("n")))
    none = F.expr(f"named_struct('at', 0, 'found', cast(array() as array<{SPAN}>))")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        span = F.struct(start.alias("start"), (start + p["n"]).alias("end"), p["m"].alias("value"))
        return F.when(p["m"].isNull(), acc).otherwise(F.struct((start + p["n"]).alias("at"), F.concat(acc["found"], F.array(span)).alias("found")))

    def placed(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / F.lit(_BLOCK)).cast("int")), lambda b: F.aggregate(F.slice(p, b * _BLOCK + 1, _BLOCK), none, step))

    def moved(blocks: Column) -> Column:
        zero = F.expr("named_struct('at', 0, 'offsets', cast(array() as array<int>))")
        offsets = F.aggregate(blocks, zero, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["offsets"], F.array(acc["at"])).alias("offsets")), lambda acc: acc["offsets"])
        shift = lambda b, o: F.transform(b["found"], lambda s: F.struct((s["start"] + o).alias("start"), (s["end"] + o).alias("end"), s["value"].alias("value")))
        return F.flatten(F.zip_with(blocks, offsets, shift))

    return let(let(pieces, placed), moved)


def propose(text: Column, pattern: str) -> Column:
    """Spans of a generator as ``find`` gives them; with a lookahead, each goes on to the end of its group 1, and spans may overlap."""
    if "(?=(" not in pattern:
        return find(text, pattern)
    rest = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.zip_with(find(text, pattern), rest, lambda s, r: F.struct(s["start"].alias("start"), (s["end"] + F.char_length(r)).alias("end"), F.concat(s["value"], r).alias("value")))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.char_length(digits)
    weight = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: let(weight(i), lambda v: F.when(v > 9, v - 9).otherwise(v))), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def base_spans(text: Column) -> Column:
    """Base spans of all kinds as (start, rank, kind, end), sorted."""

    def kept(kind: str, pattern: str, valid: Callable[[Column], Column] | None) -> Column:
        spans = find(text, pattern)
        spans = spans if valid is None else F.filter(spans, lambda s: valid(s["value"]))
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    none = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)")
    size = lambda d: F.char_length(d)
    email = F.when(F.contains(text, F.lit("@")), kept("email", EMAIL, None)).otherwise(none)
    ip = kept("ip", IP, lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    card = kept("card", CARD, lambda v: let(digits_of(v), lambda d: F.when(size(d).between(14, 19), luhn(d)).otherwise(False)))
    phone = F.when(F.contains(text, F.lit("+")), kept("phone", PHONE, lambda v: size(digits_of(v)).between(10, 15))).otherwise(none)
    return F.when(text.rlike("[0-9@]"), F.array_sort(F.concat(email, F.when(text.rlike("[0-9]"), F.concat(ip, card, phone)).otherwise(none)))).otherwise(none)


def candidates(text: Column) -> Column:
    """Proposed spans with their features, as an array of structs (start, end, kind, features...)."""
    def features_of(kind: str) -> Callable[[Column], Column]:
        def feature(s: Column) -> Column:
            d = digits_of(s["value"])
            lead = F.substring(text, F.greatest(s["start"] - CONTEXT_CHARS + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT_CHARS)))
            before, after = F.substring(text, s["start"], F.when(s["start"] > 0, 1).otherwise(0)), F.substring(text, s["end"] + 1, F.lit(1))
            side = lambda c: F.when(c.rlike(r"[A-Za-z0-9_]"), 2).when(c.rlike(r"[\x20\n,;:()\[\]]") | (c == ""), 0).otherwise(1)
            near = F.concat(F.substring(text, F.greatest(s["start"] - 5, F.lit(1)), F.least(s["start"], F.lit(6))), F.lit("|"), F.substring(text, s["end"] + 1, F.lit(6)))
            return F.struct(
                s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind_name"),
                F.lit(ALL_KINDS.index(kind)).alias("kind"),
                F.char_length(d).alias("digits"),
                (s["end"] - s["start"]).alias("length"),
                (s["end"] - s["start"] - F.char_length(F.regexp_replace(s["value"], "[^A-Za-z0-9]", ""))).alias("separators"),
                F.when(F.char_length(d) > 11, luhn(d)).otherwise(False).cast("int").alias("luhn"),
                F.when(d == "", -1).otherwise(F.substring(F.concat(d, F.lit("0")), 1, 1).cast("int")).alias("first"),
                lead.rlike(CONTEXT[kind]).cast("int").alias("context"),
                side(before).alias("before"),
                side(after).alias("after"),
                near.rlike(r"[0-9][\x20-]?\||\|[\x20-]?[0-9]").cast("int").alias("in_run"),
            )

        return feature

    parts = []
    for kind, pattern in PROPOSED:
        spans = F.transform(propose(text, pattern), features_of(kind))
        if kind in _NEEDS:
            none = F.expr("array()").cast(_CANDIDATE)
            spans = F.when(text.rlike(_NEEDS[kind]), spans).otherwise(none)
        parts.append(spans)
    return F.array_distinct(F.concat(*parts))


_CANDIDATE = "array<struct<start:int,end:int,kind_name:string," + ",".join(f"{f}:int" for f in FEATURES) + ">>"


# --- training ---------------------------------------------------------------------------------


def _luhn_digits(rng: random.Random, n: int, ok: bool) -> str:
    body = [rng.choice("3456"), *(rng.choice("0123456789") for _ in range(n - 2))]
    total = sum((v * 2 - 9 if v * 2 > 9 else v * 2) if i % 2 == 0 else v for i, v in enumerate(map(int, reversed(body))))
    check = (10 - total % 10) % 10
    return "".join(body) + str(check if ok else (check + rng.randint(1, 9)) % 10)


def _grouped(digits: str, sep: str) -> str:
    return sep.join(digits[i : i + 4] for i in range(0, 16, 4)) + digits[16:] if sep else digits


def labelled_templates(n: int = TEMPLATES, seed: int = 29) -> list[tuple[str, int, int, int]]:
    """(text, start, end, 1 if personal): a seeded set of candidate strings in the contexts where they do and do not name a person's data."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "tion", "le", "sch", "da", "mo", "ri", "que"]) for _ in range(rng.randint(1, 4)))
    words = lambda k: " ".join(word() for _ in range(k))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = []
    for _ in range(n):
        kind, yes = rng.choice(["card", "card", "phone", "local", "email", "secret"]), rng.random() < 0.5
        lead, tail = words(rng.randint(0, 6)), words(rng.randint(0, 4))
        if kind == "card":
            # Valid numbers alone, after a hint or beside another number or group of digits are cards; checksum failures, parts of codes and order numbers are not.
            sep = rng.choice(["", "", "", " ", "-"])
            value = _grouped(_luhn_digits(rng, rng.choice([14, 15, 16, 16, 16, 19]) if not sep else 16, yes), sep)
            if yes:
                hint = rng.choice(["", "", "card ", "pay with ", _luhn_digits(rng, 16, True) + " ", num(4) + (sep or " ")])
                after = rng.choice([" ", " ", ". ", ", ", " " + _luhn_digits(rng, 16, True) + " "])
            else:
                hint = rng.choice(["", "id ", "no. ", "0x", 'token = "a', num(5) + " ", num(4) + (sep or " "), "card "])
                after = rng.choice([" ", "f", "e3", ". "])
        elif kind == "phone":
            value = f"{rng.choice(['(%s)', '%s']) % num(3)}{rng.choice(' .-')}{num(3)}{rng.choice(' .-')}{num(4)}"
            hint = rng.choice(["tel ", "call ", "phone: ", "mobile "]) if yes else rng.choice(["", "", "items ", "v", "id-", num(2) + "-"])
            after = rng.choice([" ", ". ", ", "]) if yes else rng.choice([" ", "-" + num(2), "." + num(3), " x "])
        elif kind == "local":
            value = f"0{num(rng.randint(2, 4))}{rng.choice(' /-')}{num(rng.randint(5, 8))}"
            hint = rng.choice(["tel ", "phone ", "fax: ", "handy "]) if yes else rng.choice(["", "art. ", "order ", "x"])
            after = rng.choice([" ", ". "])
        elif kind == "secret":
            # A key or token follows a name for one, mostly with a sign of assignment; digests, identifiers and made-up words stand elsewhere.
            letters = rng.choice(["0123456789abcdef", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"])
            value = "a1" + "".join(rng.choice(letters) for _ in range(rng.choice([18, 22, 30, 38, 38, 62]))) if yes or rng.random() < 0.6 else f"{word()}{word()}{word()}{num(2)}{word()}{word()}{word()}{word()}"
            name = rng.choice(["token", "api_key", "secret", "password", "access_key", "auth", "client_secret"])
            hint = name + rng.choice([' = "', '="', ": ", " = ", "='", ' "']) if yes else rng.choice(["", "commit ", "id ", "sha256:", "/", "file ", "md5 ", '"'])
            after = rng.choice(['"', '" ', " ", "; "]) if yes else rng.choice([" ", ". ", "/", " ", '"'])
        else:
            value = f"{word()}{rng.choice(['', '.', '_'])}{word()}{rng.choice([' ', ''])}{rng.choice(['(at)', '[at]'])}{rng.choice([' ', ''])}{word()}{rng.choice(['.', ' (dot) ', '[dot]'])}{rng.choice(['com', 'de', 'org'] if yes else ['1', '22', word() + word()])}"
            hint = rng.choice(["mail ", "contact ", "", "write to "]) if yes else rng.choice(["", "see ", "x"])
            after = " "
        text = f"{lead} {hint}{value}{after}{tail}"
        start = len(lead) + 1 + len(hint)
        out.append((text, start, start + len(value), int(yes)))
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree for gradients g and weights h: a leaf value, or (feature, threshold, left, right)."""
    best = None
    if depth and len(g) >= 8:
        total = g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            for t in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= t
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - total
                if gain > 1e-3 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, f, int(t), left)
    if best is None:
        return round(float(RATE * g.sum() / (h.sum() + 1)), 6)
    _, f, t, left = best
    return f, t, _grow(x[left], g[left], h[left], depth - 1), _grow(x[~left], g[~left], h[~left], depth - 1)


def _leaf(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


class Model:
    """Boosted trees, a logistic calibration (slope, offset) of their sum, and a threshold for each kind."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fit: np.ndarray):
        self.trees: list = []
        margin = np.zeros(len(y))
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin[fit]))
            self.trees.append(_grow(x[fit], y[fit] - p, p * (1 - p), DEPTH))
            margin += np.array([_leaf(self.trees[-1], row) for row in x])
        m, t = margin[~fit], y[~fit]
        grid = [(a, b) for a in np.linspace(0.4, 2.0, 17) for b in np.linspace(-1, 1, 21)]
        self.slope, self.offset = min(grid, key=lambda ab: np.logaddexp(0, -(2 * t - 1) * (ab[0] * m + ab[1])).sum())
        p = 1 / (1 + np.exp(-(self.slope * m + self.offset)))
        self.threshold = {}
        for i, kind in enumerate(ALL_KINDS):
            own = x[~fit, 0] == i
            good = [c for c in np.linspace(0.5, 0.99, 50) if (chosen := own & (p >= c)).any() and t[chosen].mean() >= PRECISION]
            self.threshold[kind] = round(float(min(good)), 4) if good else 1.01

    def probability(self, c: Column) -> Column:
        """The calibrated probability of a candidate struct."""

        def cases(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            f, t, a, b = tree
            return F.when(c[FEATURES[f]] <= t, cases(a)).otherwise(cases(b))

        total = F.lit(0.0)
        for tree in self.trees:
            total = total + cases(tree)
        return 1 / (1 + F.exp(-(total * float(self.slope) + float(self.offset))))


@lru_cache(maxsize=1)
def _templates() -> tuple:
    return tuple(labelled_templates())


_models: dict[str, Model] = {}


def train(spark: SparkSession) -> Model:
    """The model; features of the labelled templates come from the same expressions as those of the corpus."""
    if "model" not in _models:
        rows = spark.createDataFrame(list(_templates()), "text string, s int, e int, y int")
        found = rows.select("s", "e", "y", F.explode(candidates(F.col("text"))).alias("c"))
        got = found.where("c.start = s and c.end = e").select("y", *(F.col(f"c.{f}").alias(f) for f in FEATURES)).collect()
        data = np.array(sorted(tuple(r) for r in got), dtype=np.int64)
        fit = np.random.default_rng(3).random(len(data)) < 0.5
        _models["model"] = Model(data[:, 1:], data[:, 0].astype(float), fit)
    return _models["model"]


# --- detection --------------------------------------------------------------------------------


def added_spans(text: Column, base: Column, model: Model) -> Column:
    """Candidates that reach their threshold, overlap no base span and no likelier candidate, as (start, rank, kind, end)."""
    limit = lambda c: F.coalesce(*(F.when(c["kind"] == ALL_KINDS.index(k), F.lit(v)) for k, v in model.threshold.items()))
    scored = F.transform(candidates(text), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("rank"), c["kind_name"].alias("kind"), c["end"].alias("end"), model.probability(c).alias("p"), limit(c).alias("limit")))
    free = F.filter(scored, lambda c: (c["p"] >= c["limit"]) & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    # From the likeliest down, each that is still free.
    ranked = F.array_sort(F.transform(free, lambda c: F.struct((-c["p"]).alias("q"), c["start"].alias("start"), c["rank"].alias("rank"), c["kind"].alias("kind"), c["end"].alias("end"))))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)")
    taken = F.aggregate(ranked, none, lambda acc, c: F.when(F.exists(acc, lambda a: (a["start"] < c["end"]) & (c["start"] < a["end"])), acc).otherwise(F.concat(acc, F.array(F.struct(c["start"], c["rank"], c["kind"], c["end"])))))
    return taken


def fresh(name: str, taken: list[str]) -> str:
    """name, or with as many underscores after it as no column has yet."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def with_spans(docs: DataFrame, model: Model, *, text: str = "text", base: str = "base_", added: str = "added_") -> DataFrame:
    """docs with two columns of arrays of (start, rank, kind, end): base spans, and those the method adds."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn(base, base_spans(body))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)")
    return out.withColumn(added, F.when(body.rlike(rf"[0-9]{{4}}|[(\[]at[)\]]|{_MIXED}"), added_spans(body, F.col(base), model)).otherwise(none))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: Model | None = None, *, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; spans that overlap become one, named by the first."""
    model = model or train(docs.sparkSession)
    base = fresh("base_", docs.columns)
    added = fresh("added_", [*docs.columns, base])
    found = with_spans(docs, model, text=text, base=base, added=added)
    spans = F.array_sort(F.concat(base, added))
    start = F.expr("named_struct('at', 0, 'out', '')")
    body = F.col(text)
    # Text up to a span that begins after what is already covered, then the span's name.
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(acc["out"]).alias("out"),
    )
    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.char_length(body))))
    return found.withColumn(text, F.when(F.size(base) + F.size(added) > 0, done).otherwise(body)).select(*docs.columns)


def contract(spark, sf_dir: str) -> DataFrame:
    """The digest of op2 for every document; n_* count base spans, n_added the method's, n_spans all."""
    found = with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), train(spark))
    count = lambda kind: F.size(F.filter("base_", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(as_text(F.col("base_")).cast("binary"), 256).alias("base_sha256"), as_text(F.array_sort(F.concat("base_", "added_"))).alias("spans"), F.size("added_").cast("long").alias("n_added"), (F.size("base_") + F.size("added_")).cast("long").alias("n_spans"))
