"""Personal data by candidate gradient boosting, with DataFrame functions only.

Generators propose spans, which may overlap: the base kinds (email, ip, card, phone) with their checks, and wider
patterns (obfuscated addresses, numbers without a plus, account codes, colon-separated addresses). Every candidate gets
a mask of format and context features. Boosted trees are fitted to counts per mask: positive are candidates that meet
a base span, negative those that meet neither a base span nor a wide candidate; what else meets a wide candidate has no
label in the corpus. Marked seed sentences stand in for kinds that have no base span, and the corpus never weighs more
than they do, so that its size settles nothing. The threshold is set on the wide candidates of the seeds, where the
wanted share of the selected ones is positive. Base spans always stay; wide candidates over the threshold that meet no
base span are added.

The fit needs a count per mask only (at most 2**11 masks), so the driver never sees a text. Candidates are found in one
pass and written; nothing else touches the texts. All repeated groups in the patterns are possessive, so that no text
can exhaust the stack, and look back at what stands before, so that no text takes quadratic time.

Null texts are empty and have no spans. Repeated rows are judged each for itself, as no row is joined. Extra columns
pass through; columns named `pii` or `redacted`, and working columns that begin with `_`, are replaced. Without any candidate in the corpus the seeds alone
make the model.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

BASE_KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: kind -> (a character that any match contains, pattern). \G is the end of the last match: from there a run may begin inside a longer one.
PATTERNS = {
    "email": ("@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "contact": ("", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[a-z0-9-]{1,64}+(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[a-z0-9-]{1,64}+){1,8}+"),
    "number": ("", r"(?<![0-9A-Za-z.])\(?[0-9]{2,}+(?:[\x20().-]{1,2}+[0-9]++){1,8}+(?![0-9A-Za-z])"),
    "code": ("", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}+)?+(?![0-9A-Za-z])"),
    "address": (":", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?::{1,2}+[0-9A-Fa-f]{1,4}+){3,7}+(?![0-9A-Za-z:])"),
}
WIDE_KINDS = tuple(k for k in PATTERNS if k not in BASE_KINDS)
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CUES = r"(?i)(?:phone|tel|tel\.|mobile|call|fax|mail|e-mail|contact|reach|write|card|visa|account|iban|ssn|social security|address|ip|id|passport|telefon|handy|konto|karte|correo|tarjeta|cuenta|teléfono|téléphone|carte|compte)\P{L}{0,3}$"
ANTI_CUES = r"(?i)(?:version|v|isbn|page|pages|chapter|section|order|item|build|release|figure|table|no|nr|year|[$€£#])\P{L}{0,3}$"

#: Sentences with personal data in [[ ]]; a candidate that meets a marked part is positive, any other negative. Each counts SEED_WEIGHT times.
SEEDS = (
    "write to [[jane.doe (at) mail (dot) org]] or call", "contact [[bob [at] corp [dot] com]] today", "mail [[info(at)shop.de]] please", "phone [[(020) 7946 0958]] now",
    "call [[212-555-0187]] after six", "tel. [[089 1234567]] bis acht", "mobile [[07700 900 123]]", "fax [[44.20.7946.0999]]", "SSN [[123-45-6789]] on file", "social security [[987 65 4321]]",
    "IBAN [[DE89 3704 0044 0532 0130 00]]", "account [[GB29NWBK60161331926819]]", "iban: [[FR14 2004 1010 0505 0001 3M02 606]]", "address [[2001:db8:85a3:0:0:8a2e:370:7334]] seen", "ip [[fe80::1ff:fe23:4567:890a]]",
    "id [[00:1b:44:11:3a:b7]] on the net", "version 10.2.33.1.7 came out", "pages 112-119 and 230-241", "in 1998-2004 they", "on 2021-03-04 it", "ISBN 978-3-16-148410-0 is", "order 2024-118-22", "build 1.2.3-45",
    "the ratio 12.5-13.5 of", "table 3.1 4.2 5.3 6.4", "scores 21 19 18 17", "from 09:30:15:22 to", "score 10:12:14:16", "item 4400-12-77", "chapter 12.4.5", "nr 77-88-99", "$ 12.500.000 paid",
)
SEED_WEIGHT = 40


@dataclass(frozen=True)
class Settings:
    trees: int = 24
    rate: float = 0.3
    #: Share of the selected wide candidates of the seeds that must be positive.
    precision: float = 0.95


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.split(F.reverse(digits), "")
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.translate(d, "123456789", "246813579").cast("int"))
    return F.aggregate(F.transform(F.filter(back, lambda d: d != ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(n.between(13, 19), luhn_ok(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _features(kind: Column, match: Column, left: Column, right: Column) -> Column:
    """A mask of format and context features, a bit each."""
    n = F.length(_digits(match))
    bits = (
        n >= 9, n >= 13, n.between(10, 15), match.rlike("[A-Za-z]"), match.rlike("[ ().-]"), match.rlike(r"@|\(at\)|\[at\]"), match.rlike(r"^\+|^\("),
        left.rlike(CUES), left.rlike(ANTI_CUES), left.rlike(r"[A-Za-z0-9]$") | right.rlike("^[A-Za-z0-9]"), match.rlike(r"^(?:[0-9]{4}[ -]?){4}$|^[A-Z]{2}[0-9]{2}|[0-9]-[0-9]{2}-[0-9]{4}$|:"),
    )
    mask = F.lit(0)
    for i, b in enumerate(bits):
        mask = mask + F.when(b, 1 << i).otherwise(0)
    return mask


N_FEATURES = 11
_CANDIDATE = "struct<start:bigint,end:bigint,kind:string,base:boolean,mask:int>"
_STEPS = "array(1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536, 131072, 262144, 524288, 1048576, 2097152, 4194304, 8388608, 16777216)"


def _running(values: Column, op: Callable[[Column, Column], Column], back: bool = True) -> Column:
    """Running results of op from the front (or from the end) of an array of bigint, by doubling steps: no array grows element by element."""

    def step(acc: Column, k: Column) -> Column:
        near = lambda i: F.get(acc, i - k if back else i + k)
        return F.when(F.size(acc) > k, F.transform(acc, lambda x, i: F.coalesce(op(x, near(i)), x))).otherwise(acc)

    return F.aggregate(F.expr(_STEPS), values, step)


def _largest(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _of_kind(kind: str, text: Column, wide_too: Column) -> Column:
    """The candidates of one kind in a text: what stands between the matches gives their places and their context."""
    needed, pattern = PATTERNS[kind]
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(s: Column) -> Column:
        steps = F.transform(s["pieces"], lambda p, i: (F.length(p) + F.when(i > 0, F.length(F.get(s["matches"], i - 1))).otherwise(0)).cast("bigint"))
        ends = F.struct(s["pieces"].alias("pieces"), s["matches"].alias("matches"), _running(steps, lambda x, y: x + y).alias("starts"))
        return F.get(F.transform(F.array(ends), lambda t: F.transform(t["matches"], lambda m, i: row(t, m, i))), F.lit(0))

    def row(t: Column, m: Column, i: Column) -> Column:
        left, right, start = F.right(F.get(t["pieces"], i), F.lit(24)), F.left(F.get(t["pieces"], i + 1), F.lit(4)), F.get(t["starts"], i)
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), F.lit(kind).alias("kind"), (F.lit(kind in BASE_KINDS) & _valid(kind, m)).alias("base"), _features(F.lit(kind), m, left, right).alias("mask"))

    found = F.get(F.transform(F.array(F.struct(pieces.alias("pieces"), matches.alias("matches"))), placed), F.lit(0))
    there = text.contains(needed) & wide_too if needed else wide_too
    return F.when(there, found).otherwise(F.expr(f"CAST(array() AS array<{_CANDIDATE}>)"))


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `_candidates`, the spans that any generator proposes, by start, and what each meets. The patterns only run where a digit or a marked at-sign occurs."""
    whole = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    t = F.col("_text")
    digit = t.rlike("[0-9]")
    needs = {"email": t.contains("@"), "contact": t.contains("(at)") | t.contains("[at]") | t.contains("(AT)") | t.contains("[AT]")}
    found = whole.withColumns({f"_{kind}": _of_kind(kind, t, needs.get(kind, digit)) for kind in PATTERNS})
    every = F.array_sort(F.concat(*[f"_{kind}" for kind in PATTERNS]))
    return found.withColumn("_candidates", _with_meetings(every)).drop("_text", *[f"_{kind}" for kind in PATTERNS])


def _with_meetings(spans: Column) -> Column:
    """Spans, sorted by start, with `near_base` and `near_wide`: whether each meets a base span, or a candidate of a wide kind; itself counts.

    One that begins before is met if the running maximum of ends passes the start, one that begins later if the running
    minimum of starts from the end is below the end: no span is compared with all others.
    """

    def met(s: Column) -> Column:
        def reach(test: Callable[[Column], Column], name: str) -> list[Column]:
            return [
                _running(F.transform(s["spans"], lambda c: F.when(test(c), c["end"]).otherwise(F.lit(-1).cast("bigint"))), _largest).alias(f"{name}_end"),
                _running(F.transform(s["spans"], lambda c: F.when(test(c), c["start"]).otherwise(F.lit(1 << 60))), _least, back=False).alias(f"{name}_start"),
            ]

        def of(r: Column) -> Column:
            meets = lambda c, i, name: (F.get(r[f"{name}_end"], i) > c["start"]) | (F.get(r[f"{name}_start"], i) < c["end"])
            return F.transform(r["spans"], lambda c, i: F.struct(*[c[x].alias(x) for x in ("start", "end", "kind", "base", "mask")], meets(c, i, "base").alias("near_base"), meets(c, i, "wide").alias("near_wide")))

        ranges = F.struct(s["spans"].alias("spans"), *reach(lambda c: c["base"], "base"), *reach(lambda c: c["kind"].isin(*WIDE_KINDS), "wide"))
        return F.get(F.transform(F.array(ranges), of), F.lit(0))

    return F.get(F.transform(F.array(F.struct(spans.alias("spans"))), met), F.lit(0))


def _meets(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _counts(found: DataFrame, positive: Callable[[Column], Column], labelled: Callable[[Column], Column]) -> DataFrame:
    """Labelled candidates per mask, class and whether their kind is wide."""
    of = lambda c: F.struct(c["mask"].alias("mask"), positive(c).alias("positive"), c["kind"].isin(*WIDE_KINDS).alias("wide"))
    each = found.select(F.explode(F.transform(F.filter("_candidates", labelled), of)).alias("c"))
    return each.groupBy("c.mask", "c.positive", "c.wide").count()


@dataclass
class Model:
    """start and trees over feature bits: (bit, bit if set, bit if not, four leaves: not/not, not/set, set/not, set/set)."""

    start: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    threshold: float = 0.5

    def margin(self, mask: int) -> float:
        total = self.start
        for a, b1, b0, leaves in self.trees:
            x = mask >> a & 1
            total += leaves[2 * x + (mask >> (b1 if x else b0) & 1)]
        return total

    def column(self, mask: Column) -> Column:
        total = F.lit(self.start)
        bit = lambda i: F.getbit(mask, F.lit(i)) == 1
        for a, b1, b0, leaves in self.trees:
            total = total + F.when(bit(a), F.when(bit(b1), leaves[3]).otherwise(leaves[2])).otherwise(F.when(bit(b0), leaves[1]).otherwise(leaves[0]))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _split(cells: dict[int, tuple[float, float]], bits: list[int]) -> tuple[int, float]:
    """The bit whose split of the cells (gradient, hessian) gains most, and the gain."""
    best = (bits[0], 0.0)
    for b in bits:
        sums = [[0.0, 1.0], [0.0, 1.0]]
        for mask, (g, h) in cells.items():
            s = sums[mask >> b & 1]
            s[0] += g
            s[1] += h
        gain = sum(g * g / h for g, h in sums)
        if gain > best[1]:
            best = (b, gain)
    return best


def boost(cells: dict[int, tuple[float, float]], s: Settings) -> Model:
    """Gradient boosting with the logistic loss over cells mask -> (negatives, positives)."""
    n0, n1 = (sum(c[k] for c in cells.values()) + 1.0 for k in (0, 1))
    model = Model(math.log(n1 / n0))
    margins = dict.fromkeys(cells, model.start)
    bits = list(range(N_FEATURES))
    for _ in range(s.trees):
        grads = {}
        for mask, (neg, pos) in cells.items():
            p = 1 / (1 + math.exp(-margins[mask]))
            grads[mask] = (pos - (neg + pos) * p, (neg + pos) * p * (1 - p))
        a, _ = _split(grads, bits)
        sides = [{m: g for m, g in grads.items() if m >> a & 1 == x} for x in (0, 1)]
        b = [_split(side, [i for i in bits if i != a])[0] for side in sides]
        leaves = []
        for x in (0, 1):
            for y in (0, 1):
                own = [g for m, g in sides[x].items() if m >> b[x] & 1 == y]
                leaves.append(s.rate * sum(g for g, _ in own) / (sum(h for _, h in own) + 1.0))
        tree = (a, b[1], b[0], tuple(leaves))
        model.trees.append(tree)
        for mask in margins:
            x = mask >> a & 1
            margins[mask] += leaves[2 * x + (mask >> b[x] & 1)]
    return model


def _calibrate(model: Model, labelled: dict[int, tuple[float, float]], precision: float) -> float:
    """The least score from which on the wanted share of the candidates is positive; over 1 if there is none."""
    scored = sorted(((1 / (1 + math.exp(-model.margin(m))), neg, pos) for m, (neg, pos) in labelled.items()), reverse=True)
    found, n0, n1 = 2.0, 0.0, 0.0
    for k, (p, neg, pos) in enumerate(scored):
        n0, n1 = n0 + neg, n1 + pos
        if (k + 1 == len(scored) or scored[k + 1][0] < p) and n1 >= precision * (n0 + n1) and n1 > 0:
            found = p
    return found


def fit(found: DataFrame, settings: Settings | None = None) -> Model:
    """The model from candidates (with_candidates), in one aggregation; the driver gets a row per mask and class."""
    s = settings or Settings()
    spark = found.sparkSession
    corpus = _counts(found, lambda c: c["near_base"], lambda c: c["near_base"] | ~c["near_wide"]).collect()
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(SEEDS)], "doc_id long, marked string").withColumn("text", F.regexp_replace(F.regexp_replace("marked", r"\[\[", ""), r"\]\]", ""))
    mark = F.struct((F.instr("marked", "[[") - 1).cast("long").alias("start"), F.when(F.col("marked").contains("]]"), F.instr("marked", "]]") - 3).otherwise(-1).cast("long").alias("end"))
    seeds = with_candidates(texts.withColumn("_mark", mark))
    seeds = _counts(seeds, lambda c: (F.col("_mark.end") > 0) & _meets(F.col("_mark"), c), lambda c: F.lit(True)).collect()
    fitted: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
    kept: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
    weight = min(1.0, SEED_WEIGHT * sum(r["count"] for r in seeds) / max(1, sum(r["count"] for r in corpus)))
    for r in corpus:
        fitted[r["mask"]][r["positive"]] += weight * r["count"]
    for r in seeds:
        fitted[r["mask"]][r["positive"]] += SEED_WEIGHT * r["count"]
        if r["wide"]:
            kept[r["mask"]][r["positive"]] += SEED_WEIGHT * r["count"]
    model = boost({m: tuple(c) for m, c in fitted.items()}, s)
    model.threshold = _calibrate(model, {m: tuple(c) for m, c in kept.items()}, s.precision)
    return model


def select(found: DataFrame, model: Model) -> DataFrame:
    """found with `pii`: base spans, and wide candidates over the threshold that meet none of them; by kind, then start."""
    order = {k: i for i, k in enumerate(PATTERNS)}
    rank = F.create_map(*[F.lit(x) for k in order for x in (k, order[k])])
    chosen = F.filter("_candidates", lambda c: c["base"] | (c["kind"].isin(*WIDE_KINDS) & ~c["near_base"] & (model.column(c["mask"]) >= model.threshold)))
    spans = F.array_sort(F.transform(chosen, lambda c: F.struct(rank[c["kind"]].alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    return found.withColumn("pii", F.transform(spans, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))).drop("_candidates")


def find_pii(docs: DataFrame, settings: Settings | None = None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with `pii`, an array of (kind, start, end) in code points. One pass over the texts; the candidates are written once."""
    found = stored(with_candidates(docs, text) if keep_text else with_candidates(docs, text).drop(text))
    return select(found, fit(found, settings))


#: Code points of a block of text: a cut reads the blocks that it touches, never the text from its beginning.
BLOCK = 4096


def redact(found: DataFrame, text: str = "text", out: str = "redacted") -> DataFrame:
    """found (with `pii`) with a copy of the text in which each group of overlapping spans is one `[KIND]`, by its first span."""
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    whole = F.col(text)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(whole) / BLOCK).cast("int")), lambda i: F.substring(whole, i * BLOCK + 1, F.lit(BLOCK)))
    spans = F.array_sort(F.transform("pii", lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), c["kind"].alias("kind"))))

    def cut(s: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / BLOCK).cast("int")
        some = F.array_join(F.slice(s["blocks"], first + 1, F.floor(b / BLOCK).cast("int") - first + 1), "")
        return F.substring(some, (a % BLOCK + 1).cast("int"), (b - a).cast("int"))

    def groups(s: Column) -> Column:
        """Where groups of overlapping spans begin: a span that no earlier one reaches."""
        index = F.sequence(F.lit(0), F.size(s["spans"]) - 1)
        heads = F.filter(index, lambda i: (i == 0) | (F.get(s["spans"], i)["start"] >= F.get(s["ends"], i - 1)))
        return bind(F.struct(*[s[x].alias(x) for x in ("blocks", "spans", "ends")], heads.alias("heads")), joined)

    def joined(s: Column) -> Column:
        n = F.size(s["heads"])
        last = lambda j: F.get(s["ends"], F.coalesce(F.get(s["heads"], j + 1), F.size(s["spans"])) - 1)

        def part(h: Column, j: Column) -> Column:
            span = F.get(s["spans"], h)
            return F.concat(cut(s, F.when(j == 0, F.lit(0).cast("bigint")).otherwise(last(j - 1)), span["start"]), F.lit("["), F.upper(span["kind"]), F.lit("]"))

        rest = F.substring(F.array_join(F.slice(s["blocks"], F.floor(last(n - 1) / BLOCK).cast("int") + 1, F.size(s["blocks"])), ""), (last(n - 1) % BLOCK + 1).cast("int"), F.lit(1 << 30))
        return F.concat(F.array_join(F.transform(s["heads"], part), ""), rest)

    ends = lambda s: bind(F.struct(s["blocks"].alias("blocks"), s["spans"].alias("spans"), _running(F.transform(s["spans"], lambda c: -c["back"]), _largest).alias("ends")), groups)
    done = bind(F.struct(blocks.alias("blocks"), spans.alias("spans")), ends)
    return found.withColumn(out, F.when(F.size("pii") == 0, whole).otherwise(done))


def digests(docs: DataFrame) -> DataFrame:
    """Per document: the counts and the digest of the base kinds, and all spans as text."""

    def of(kind: str) -> Column:
        return F.filter("pii", lambda c: c["kind"] == kind)

    found = find_pii(docs.select("doc_id", "text"), keep_text=False)
    named = F.transform("pii", lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string")))
    base = F.transform(F.filter("pii", lambda c: c["kind"].isin(*BASE_KINDS)), lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string")))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(named, ",").alias("spans"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))


#: Places of regex matches have no plain SQL; tests compare with brute force.
QUERIES = {"op9_pii": op9_pii}
