"""Personal data: generated candidates, boosted trees, calibrated thresholds (native).

Base spans follow fixed rules (``BASE``).  For each kind a looser pattern
(``LOOSE``) proposes more spans, which may overlap those of other kinds.  A
proposal is described by small features of its surroundings and of its plain
form: a leading "+", separators and spelled-out marks, by which base spans
differ from unlisted forms, are taken out first (``plain``).  The check digit of
a card and the parts of an address are no matter of writing and stay.
Boosted trees of depth two learn, per kind, from which features a proposal
holds a base span.

A proposal without a base span is not labelled: it may be an unlisted form or
something else.  Behind a cue word of its kind the well-scored proposals count
as real, so the part of them with base spans tells how many real ones the base
patterns see (``seen_part``).  The base spans over that part estimate the real
ones above a score; a threshold per kind is calibrated on the held-out fold so
that they are ``PRECISION`` of the proposals there.  However common an unlisted
form is, it lowers both sides alike.  Proposals that pass and touch no base
span are added.

Proposals are counted by kind, fold and feature vector over all documents, into a
written table.  The trees of a kind are fitted on these counts; of more than
``CELLS`` vectors a sample by priority (count over a hash of the vector) takes
part, with weights that keep every expected count.  Thresholds are calibrated on
the counts by score (``SCORE_DIGITS`` decimals) over all proposals of the
held-out fold, added up by Spark.  The trees become plain column expressions:
scoring is one map over the texts, without a shuffle.

Credentials (``secret_spans``) have a generator of their own and no trees, as no
base pattern labels them: the value of an assignment to a credential word,
fixed key forms, and the first line of a private key.

Offsets are code points, ends exclusive.  Patterns are written with possessive
repeats and start conditions so that long texts take linear time.

* null or empty text: no spans
* null ids, repeated rows and other columns pass as they are
* no base spans of a kind in the learning folds or in the held-out one: there is
  nothing to learn from, nothing is added.  A threshold counts ``UNSEEN`` more
  proposals than there are, so few base spans alone support none
* no base spans of a kind behind its cue words: every proposal without a base
  span counts as something else
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotline.llm.common import HELD_OUT_FOLD, drop_table, fold, sha256_hex, table, text_or_empty, write_table

KINDS = ("email", "ip", "card", "phone")
# The base patterns.  \G or the look-behind only skip starts that can't begin a leftmost match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?+(?:@|\(at\)|\[at\])\x20?+[A-Za-z0-9-]++"
             r"(?:(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){2,}+",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,}+",
    "phone": r"(?<![0-9])[+(]?+[0-9][\x20().0-9-]+[0-9]",
}
DIGITS = {"card": (16, 19), "phone": (8, 15)}
LOOSE_DIGITS = {"card": (12, 19), "phone": (7, 15)}
MARK = {"email": "@|\\(at\\)|\\[at\\]", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "[0-9]"}
# Words that often stand before each kind, and before other numbers.
CUES = ("call|phone|tel|fax|mobile", "card|visa|account", "host|server|address", "mail|contact|write",
        "pass|key|token|version|order|number|id")
OWN_CUE = {"phone": 1, "card": 2, "ip": 3, "email": 4}
CUE_CHARS = 24
# Words that credentials are assigned to, and forms that name themselves.
SECRET_WORD = (r"(?i:passwords?|passwd|pwd|secrets?|tokens?|credentials?|(?:api|access|secret|private|auth)[_-]?key)"
               r"[\"']?\x20?[:=]\x20?[\"']?")
SECRET = (rf"{SECRET_WORD}[^\s\"',;]{{8,}}+"
          r"|\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,})\b|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")
SECRET_MARK = ("pass", "pwd", "secret", "token", "credential", "key", "akia", "gho_", "ghp_", "ghr_", "ghs_", "ghu_", "sk-")
FEATURES = ("digits", "marks", "dots", "length", "before", "after", "cue", "varied", "last", "sum_digit")

CELLS = 50_000
TREES = 30
RATE = 0.3
SMOOTH = 1.0
PRECISION = 0.98
TYPICAL = 0.9
UNSEEN = 0.5
SCORE_DIGITS = 2


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, m>> of the leftmost non-overlapping matches.

    A match begins after all the pieces and matches before it.  Their lengths
    are added up in blocks of 64, so that thousands of matches stay cheap.
    """
    def sum_of(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def place(v: Column) -> Column:
        lens = F.zip_with(F.slice(v["p"], 1, F.size(v["m"])), v["m"], lambda p, m: F.length(p) + F.length(m))
        return let(lens, lambda n: let(blocks(n), lambda b: F.transform(v["m"], lambda m, k: let(
            b[(k / 64).cast("int")] + sum_of(F.slice(n, (k / 64).cast("int") * 64 + 1, k % 64)) + F.length(v["p"][k]),
            lambda s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("m"))))))

    def blocks(n: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), ((F.size(n) - 1) / 64).cast("int")),
                           lambda b: sum_of(F.slice(n, b * 64 + 1, 64)))
        return let(each, lambda e: F.transform(e, lambda _, b: sum_of(F.slice(e, 1, b))))

    found = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"))
    return let(found, lambda v: F.when(F.size(v["m"]) > 0, place(v)).otherwise(nothing()))


def nothing() -> Column:
    return F.array().cast("array<struct<start:int,end:int,m:string>>")


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total, i, r):
        d = F.substring(r, i, 1).cast("int")
        return total + F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    return let(F.reverse(digits), lambda r: F.aggregate(
        F.sequence(F.lit(1), F.length(r)), F.lit(0), lambda t, i: add(t, i, r)) % 10 == 0)


def valid(kind: str, m: Column) -> Column:
    """Whether a base match passes its kind's test."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: F.when(
            F.length(q) <= 3, q.cast("int") <= 255).otherwise(False)))
    low, high = DIGITS[kind]
    return let(digits_of(m), lambda d: F.when(
        F.length(d).between(low, high), luhn(d) if kind == "card" else F.lit(True)).otherwise(False))


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, BASE[kind]), lambda x: valid(kind, x["m"]))
    return F.when(text.rlike(MARK[kind]), found).otherwise(nothing())


def loose_spans(text: Column, kind: str) -> Column:
    found = matches(text, LOOSE[kind])
    if kind in LOOSE_DIGITS:
        found = F.filter(found, lambda x: F.length(digits_of(x["m"])).between(*LOOSE_DIGITS[kind]))
    return F.when(text.rlike(MARK[kind]), found).otherwise(nothing())


def secret_spans(text: Column) -> Column:
    """array<struct<start, end, m>> of credentials; an assigned value needs more than letters."""
    # of an assignment only the value
    value = F.transform(matches(text, SECRET), lambda x: let(F.regexp_replace(x["m"], f"^{SECRET_WORD}", ""), lambda v: F.struct(
        (x["end"] - F.length(v)).alias("start"), x["end"].alias("end"), v.alias("m"))))
    found = F.filter(value, lambda x: x["m"].rlike("[^A-Za-z]|^AKIA[A-Z]{16}$"))
    # a plain search for the words is much cheaper than the pattern
    marked = let(F.lower(text), lambda t: F.exists(F.array(*map(F.lit, SECRET_MARK)), lambda w: t.contains(w)))
    return F.when(marked, found).otherwise(nothing())


def char_class(c: Column) -> Column:
    return (F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike("[0-9]"), 3)
            .when(c.rlike("[.,;:!?)]"), 4).otherwise(5))


def plain(kind: str, m: Column) -> Column:
    """A proposal without what the base patterns ask of its writing."""
    if kind == "email":
        at = F.regexp_replace(m, r"\x20?(?:@|\(at\)|\[at\])\x20?", "@")
        return F.regexp_replace(at, r"\x20?(?:\(dot\)|\[dot\])\x20?", ".")
    return m if kind == "ip" else digits_of(m)


def features(text: Column, c: Column, kind: str) -> Column:
    return let(plain(kind, c["m"]), lambda m: form_and_context(text, c, m, kind))


def form_and_context(text: Column, c: Column, m: Column, kind: str) -> Column:
    """Small integers about a proposal's plain form ``m`` and its surroundings."""
    def count(p: str) -> Column:
        return F.length(F.regexp_replace(m, p, ""))
    before = F.when(c["start"] > 0, F.substring(text, c["start"], 1)).otherwise("")
    ahead = F.lower(F.substring(text, F.greatest(c["start"] - CUE_CHARS, F.lit(0)) + 1, F.least(c["start"], F.lit(CUE_CHARS))))
    cue = F.lit(0)
    for n, words in reversed(list(enumerate(CUES))):
        cue = F.when(ahead.rlike(rf"\b(?:{words})"), n + 1).otherwise(cue)
    fits = F.when(luhn(F.concat(F.lit("0"), m)), 1).otherwise(0) if kind == "card" else F.lit(0)
    varied = F.size(F.array_distinct(F.split(digits_of(m), "")))
    return F.struct(
        F.least(count("[^0-9]"), F.lit(20)).alias("digits"), F.least(count("[^ ()-]"), F.lit(6)).alias("marks"),
        F.least(count("[^.]"), F.lit(6)).alias("dots"), F.least((F.length(m) / 4).cast("int"), F.lit(10)).alias("length"),
        char_class(before).alias("before"), char_class(F.substring(text, c["end"] + 1, 1)).alias("after"),
        cue.alias("cue"), F.least(varied, F.lit(10)).alias("varied"),
        F.least(F.length(F.substring_index(m, ".", -1)), F.lit(8)).alias("last"), fits.alias("sum_digit"))


def with_spans(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the base and the loose spans of each kind, as array columns."""
    t = text_or_empty(text)
    return df.withColumns({f"_ll_base_{k}": base_spans(t, k) for k in KINDS}
                          | {f"_ll_loose_{k}": loose_spans(t, k) for k in KINDS})


def holds_base(c: Column, kind: str) -> Column:
    return F.exists(f"_ll_base_{kind}", lambda b: (b["start"] >= c["start"]) & (b["end"] <= c["end"]))


# ---- boosted trees on counted feature vectors

def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, list]:
    """(start, trees): logistic boosting; a tree is (feature, cut, side, side) with a
    (feature, cut, value, value) on each side, ``<= cut`` first."""
    share = ((w * y).sum() + SMOOTH) / (w.sum() + 2 * SMOOTH)
    start = float(np.log(share / (1 - share)))
    f, trees = np.full(len(y), start), []

    def best(rows):
        g, h = w[rows] * (y[rows] - p[rows]), w[rows] * p[rows] * (1 - p[rows])
        top = (-1.0, 0, 0)
        for j in range(x.shape[1]):
            for cut in np.unique(x[rows, j])[:-1]:
                a = x[rows, j] <= cut
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + SMOOTH) for s in (a, ~a))
                top = max(top, (gain, j, int(cut)))
        return top[1:]

    def value(rows):
        g, h = (w[rows] * (y[rows] - p[rows])).sum(), (w[rows] * p[rows] * (1 - p[rows])).sum()
        return float(round(RATE * g / (h + SMOOTH), 6))

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        rows = np.arange(len(y))
        j, cut = best(rows)
        sides = []
        for side in (rows[x[:, j] <= cut], rows[x[:, j] > cut]):
            k, c = best(side) if len(side) else (0, 0)
            leaves = [s for s in (side[x[side, k] <= c], side[x[side, k] > c])]
            v = [value(s) if len(s) else 0.0 for s in leaves]
            for s, a in zip(leaves, v):
                f[s] += a
            sides.append((k, c, *v))
        trees.append((j, cut, *sides))
    return start, trees


def score_cells(model, x: np.ndarray) -> np.ndarray:
    start, trees = model
    f = np.full(len(x), start)
    for j, cut, *sides in trees:
        v = [np.where(x[:, k] <= c, a, b) for k, c, a, b in sides]
        f += np.where(x[:, j] <= cut, *v)
    return f


def score_column(model, feature: Column) -> Column:
    start, trees = model

    def side(k, c, a, b):
        return F.when(feature[FEATURES[k]] <= c, a).otherwise(b)
    total = F.lit(start)
    for j, cut, low, high in trees:
        total = total + F.when(feature[FEATURES[j]] <= cut, side(*low)).otherwise(side(*high))
    return total


def seen_part(score: np.ndarray, y: np.ndarray, w: np.ndarray, own: np.ndarray) -> float:
    """The part of the real ones that hold base spans: that of the proposals behind a cue
    of their kind, from the score that ``TYPICAL`` of the base spans there reach."""
    all_base = (w * y)[own].sum()
    for least in np.unique(score[own])[::-1]:
        top = own & (score >= least)
        if all_base and (w * y)[top].sum() >= TYPICAL * all_base:
            return float((w * y)[top].sum() / w[top].sum())
    return 1.0


def least_score(score: np.ndarray, y: np.ndarray, w: np.ndarray, part: float) -> float | None:
    """The smallest threshold that is precise enough, if ``part`` of the real ones hold base spans."""
    for least in np.unique(score):
        top = score >= least
        if (w * y)[top].sum() >= PRECISION * part * (w[top].sum() + UNSEEN):
            return float(least)
    return None


def fit(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> dict:
    """kind -> (trees, least score); kinds without base spans, or without a precise
    enough threshold, are left out."""
    t = text_or_empty(text)
    wide = with_spans(df.select(F.col(doc_id), F.col(text)), text).withColumn("_ll_out", fold(doc_id) == HELD_OUT_FOLD)

    def described(kind: str) -> Column:
        return F.transform(f"_ll_loose_{kind}", lambda c: F.struct(
            F.lit(kind).alias("kind"), holds_base(c, kind).alias("y"), features(t, c, kind).alias("x")))

    proposals = F.concat(*[described(k) for k in KINDS])
    rows = wide.select("_ll_out", F.explode(proposals).alias("c")).select("_ll_out", "c.kind", "c.y", "c.x.*")
    cells = write_table(rows.groupBy("_ll_out", "kind", "y", *FEATURES).count(), "pii-cells")
    seen = {(r["kind"], r["_ll_out"]) for r in cells.where("y").select("kind", "_ll_out").distinct().collect()}
    models = {}
    for kind in KINDS:
        if not {(kind, False), (kind, True)} <= seen:
            continue
        own = cells.where(F.col("kind") == kind)
        model = boost(*fitting_cells(own.where("not _ll_out")))
        score, y, w, cue = scored_cells(own.where("_ll_out"), model, kind)
        least = least_score(score, y, w, seen_part(score, y, w, cue))
        if least is not None:
            models[kind] = (model, least)
    drop_table(cells)
    return models


def fitting_cells(cells: DataFrame, most: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, label, weight) of at most ``most`` counted vectors.  Of more, those with the
    highest count / u stay, u uniform by hash; a weight is at least the first priority left out,
    which keeps the expected count of any set of vectors."""
    u = (F.pmod(F.xxhash64("y", *FEATURES), F.lit(1 << 30)) + 1) / F.lit(1 << 30)
    got = cells.select("y", *FEATURES, "count", (F.col("count") / u).alias("_ll_priority")) \
               .orderBy(F.desc("_ll_priority"), "y", *FEATURES).limit(most + 1).collect()
    floor = got[most]["_ll_priority"] if len(got) > most else 0.0
    got = got[:most]
    x = np.array([[r[f] for f in FEATURES] for r in got]).reshape(-1, len(FEATURES))
    return x, np.array([float(r["y"]) for r in got]), np.array([max(float(r["count"]), floor) for r in got])


def scored_cells(cells: DataFrame, model, kind: str) -> tuple[np.ndarray, ...]:
    """(score, label, weight, behind an own cue), one row for each rounded score: all proposals
    are counted; the scores of the trees are bounded, so these rows are."""
    score = F.round(score_column(model, F.struct(*FEATURES)), SCORE_DIGITS).alias("score")
    got = cells.groupBy(score, "y", (F.col("cue") == OWN_CUE[kind]).alias("own")).agg(F.sum("count").alias("w")) \
               .orderBy("score", "y", "own").collect()
    return (*(np.array([float(r[c]) for r in got]) for c in ("score", "y", "w")), np.array([r["own"] for r in got], bool))


def find_spans(df: DataFrame, models: dict, *, text: str = "text") -> DataFrame:
    """``df`` with ``base`` and ``spans``: array<struct<kind, start, end>> in order of kind and start."""
    t = text_or_empty(text)
    wide = with_spans(df, text)
    any_base = F.concat(*[F.col(f"_ll_base_{k}") for k in KINDS])

    def tagged(k: str, spans: Column) -> Column:
        return F.transform(F.array_sort(spans), lambda s: F.struct(
            F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def added(k: str) -> Column:
        if k not in models:
            return nothing()
        model, least = models[k]
        return F.filter(f"_ll_loose_{k}", lambda c: ~F.exists(
            any_base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
            & let(features(t, c, k), lambda x: F.round(score_column(model, x), SCORE_DIGITS) >= least))

    base = F.concat(*[tagged(k, F.col(f"_ll_base_{k}")) for k in KINDS])
    spans = F.concat(*[tagged(k, F.concat(F.col(f"_ll_base_{k}"), added(k))) for k in KINDS])
    return wide.withColumns({"base": base, "spans": spans}) \
               .drop(*[f"_ll_{w}_{k}" for w in ("base", "loose") for k in KINDS])


def redact(df: DataFrame, models: dict, *, text: str = "text") -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in brackets; where spans
    overlap, the first one (the longest of equal starts) stands."""
    t = text_or_empty(text)
    found = find_spans(df, models, text=text)
    order = F.array_sort(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    parts = F.aggregate(order, zero, lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(
        (-s["last"]).alias("at"), F.concat(a["out"], F.array(
            F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), s["kind"], F.lit("]")))).alias("out"))))
    return found.withColumn(text, let(parts, lambda p: F.concat(
        F.array_join(p["out"], ""), F.substring(t, p["at"] + 1, F.length(t))))).drop("base", "spans")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_boosted_pii(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = find_spans(docs, fit(docs))

    def number(kind: str) -> Column:
        return F.size(F.filter("base.kind", lambda k: k == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(number, KINDS), sha256_hex(spans_text(F.col("base"))).alias("base_sha256"),
                      spans_text(F.col("spans")).alias("spans"),
                      F.array_join(F.transform(secret_spans(text_or_empty()), lambda x: F.concat_ws(":", F.lit("secret"), x["start"], x["end"])),
                                   ",").alias("secrets"))
