"""Benchmark decontamination by templates, with DataFrame functions only.

Texts are cut into runs of letters and digits. Numbers and units after a number become typed placeholders; capitalised
words are slots between the other words, of any number of words, so that another name, or a name of another length,
moves nothing. Windows of five template tokens are hashed and joined with those of the benchmark. Each match brings the
values in its slots: a number, a unit or a name (of a full name the last part) of the item must always stand for the same value of the
document; a capitalised word that begins a sentence need not be a name and is left out of that check. An item is found in a document
if windows with consistent slots cover at least 80 % of its template tokens: those along one alignment, or those along
several alignments if their slots agree as well. Equal slots make an exact copy, others a re-parameterised one.

Items whose windows cannot reach that share, because they have too few words besides numbers and names, are found by
windows of five plain tokens, values included, at the same share; items of under five tokens where a document has nothing else.

Shape of the job: one pass over the texts that keeps only windows which a bit table of the benchmark's windows lets
through (the table has a fixed size; when it is too full it only lets more through), then an exact join on the hash,
then groups of one document, item and alignment. The benchmark's side is broadcast only if it has few windows.

Null and empty texts match nothing, nor does an item without tokens. Rows are told apart by id and text: equal rows share
their verdict. Extra columns of the documents pass through `decontaminate` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Private-use characters. NUMBER and UNIT stand for numbers and units; DOT keeps a decimal in one token; NAME and START mark
#: capitalised words inside and at the beginning of a sentence, and GLUE ties them to the token that follows; END closes a text.
NUMBER, UNIT, DOT, NAME, START, GLUE, END, AFTER = (chr(0xE000 + i) for i in range(8))
_MARKS = f"{NUMBER}-{AFTER}"
#: Words that count as a unit where they follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros pound pounds meter meters metre metres kilometer kilometers mile miles gram grams kilogram kilograms liter liters percent degrees"
)
#: More windows of the benchmark than this are joined by a shuffle instead of a broadcast (about 150 bytes each).
MOST_BROADCAST = 100_000


@dataclass(frozen=True)
class Settings:
    window: int = 5
    min_share: float = 0.8
    min_plain: int = 2
    #: The bit table has 128 bits for each window of the benchmark, within these bounds (powers of two): 512 KB at most.
    bits_from: int = 16
    bits_upto: int = 22


_WORD = r"[\p{L}\p{N}]"
_CAPITALISED = rf"(\p{{Lu}}\p{{Ll}}{_WORD}*+)[^\p{{L}}\p{{N}}{_MARKS}]*+"


def tokens(text: Column) -> Column:
    """The runs of letters and digits of a text in lower case, without capitalised words, which stand before their next token as
    `NAME word GLUE` or `START word GLUE`; units are marked by a leading UNIT."""
    units = "|".join(UNITS.split())
    whole = F.concat(F.regexp_replace(text, f"[{_MARKS}]", " "), F.lit(f" {END}"))
    numeric = F.regexp_replace(F.regexp_replace(whole, r"(?<=[0-9])[.,](?=[0-9])", DOT), rf"([0-9]\s?)(?=(?:{units})\b)", f"$1 {UNIT}")
    marked = F.when(text.rlike("[0-9]"), numeric).otherwise(whole)
    named = F.regexp_replace(marked, rf"(?=\p{{Lu}}\p{{Ll}})(?<=[\p{{L}}\p{{N}},;)] ){_CAPITALISED}", f"{NAME}$1{GLUE}")
    started = F.regexp_replace(named, rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{N}}{_MARKS}]){_CAPITALISED}", f"{START}$1{GLUE}")
    words = F.array_remove(F.split(F.lower(started), rf"[^\p{{L}}\p{{N}}{_MARKS}]+"), "")
    return F.get(F.transform(F.array(words), lambda w: F.slice(w, 1, F.size(w) - 1)), F.lit(0))  # without END


def core(token: Column) -> Column:
    """A token without the capitalised words before it."""
    return F.when((token >= NAME) & (token < AFTER), F.substring_index(token, GLUE, -1)).otherwise(token)


def _placeholder(word: Column) -> Column:
    return F.when((word >= UNIT) & (word < DOT), F.lit(UNIT)).when((word < ":") & (word >= "0"), F.lit(NUMBER))


def template(token: Column) -> Column:
    """The placeholder of a number or a unit; a plain word itself."""
    plain = lambda w: F.coalesce(_placeholder(w), w)
    return F.when((token >= NAME) & (token < AFTER), plain(core(token))).otherwise(plain(token))


def _name(token: Column) -> Column:
    """The last of the words before a token that are names by their place: of a full name the last part, whatever stands before it."""
    return F.when((token >= NAME) & (token < AFTER), F.regexp_extract(token, f"^.*{NAME}([^{GLUE}]+)", 1)).otherwise("")


def _slots(cut: Column) -> Column:
    """Of each token of a window its value if it is a slot, and the name before it."""
    return F.transform(cut, lambda w: F.struct(F.when(template(w) != core(w), core(w)).alias("value"), _name(w).alias("name")))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(template(w)))


def _window_hash(hashes: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[hashes[at + j] for j in range(k)])


def _covered(places: Column, k: int) -> Column:
    """How many tokens windows at these places cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda a: F.sequence(a, a + (k - 1))))))


def benchmark_windows(bench: DataFrame, item: str, text: str, s: Settings) -> DataFrame:
    """A row (_h, _item, _at, _n, _slots) per window of an item that has words enough; _n: template tokens of the item."""
    plain = F.size(F.filter("_cut", lambda w: _placeholder(core(w)).isNull()))
    rows = (
        bench.select(F.col(item).alias("_item"), F.col(text).alias("_text"), tokens(F.col(text)).alias("_words"))
        .withColumn("_n", F.size("_words")).filter(F.col("_n") >= s.window)
        .withColumn("_hashes", _hashes(F.col("_words")))
        .withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_n") - s.window)))
        .withColumn("_cut", F.slice("_words", F.col("_at") + 1, s.window)).filter(plain >= s.min_plain)
        .select(_window_hash(F.col("_hashes"), F.col("_at"), s.window).alias("_h"), "_item", "_text", "_at", "_n", _slots(F.col("_cut")).alias("_slots"))
    )
    enough = rows.groupBy("_item", "_text", "_n").agg(_covered(F.collect_set("_at"), s.window).alias("_covered")).filter(F.col("_covered") >= F.lit(s.min_share) * F.col("_n"))
    return rows.join(enough.select("_item", "_text"), ["_item", "_text"], "left_semi").drop("_text")


def plain_tokens(text: Column) -> Column:
    """The runs of letters and digits of a text in lower case, whatever they are."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def plain_items(bench: DataFrame, templated: DataFrame, item: str, text: str) -> DataFrame:
    """(_item, _words) of items without template windows, but not of those without tokens."""
    rows = bench.select(F.col(item).alias("_item"), plain_tokens(F.col(text)).alias("_words")).filter(F.size("_words") > 0)
    own = templated.select(F.col("_item").alias("_other")).distinct()
    return rows.join(own, rows["_item"].eqNullSafe(own["_other"]), "left_anti")


def _bit_table(windows: DataFrame, bits: int) -> DataFrame:
    """One row: as JSON, an array of 2**(bits-6) longs, in which the bit of each window's hash is set."""
    spark = windows.sparkSession
    slots = windows.select(F.shiftrightunsigned("_h", 70 - bits).alias("slot"), F.expr("shiftleft(1L, CAST(_h & 63 AS INT))").alias("bit"))
    filled = spark.range(1 << (bits - 6)).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("bit")).unionAll(slots).groupBy("slot").agg(F.bit_or("bit").alias("bit"))
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "bit"))), lambda x: x["bit"]).alias("table")).select(F.to_json("table").alias("table"))


def _hits(words: DataFrame, hashes: Column, windows: DataFrame, n: int, k: int, s: Settings) -> DataFrame:
    """(_doc, _text_hash, _h, _pos, _cut) of windows of the documents that may be among the n windows."""
    bits = min(max((128 * n).bit_length(), s.bits_from), s.bits_upto)
    table = F.from_json(F.lit(_bit_table(windows, bits).first().table), "array<bigint>")  # folded into one literal

    def known(h: Column) -> Column:
        return F.getbit(F.get(table, F.shiftrightunsigned(h, 70 - bits).cast("int")), h.bitwiseAND(63).cast("int")) == 1

    return (
        words.filter(F.size("_words") >= k)
        .withColumn("_hashes", hashes)
        .withColumn("_windows", F.transform(F.sequence(F.lit(0), F.size("_words") - k), lambda i: _window_hash(F.col("_hashes"), i, k)))
        .withColumn("_hits", F.filter(F.sequence(F.lit(0), F.size("_words") - k), lambda i: known(F.get("_windows", i))))
        .select("_doc", "_text_hash", F.explode(F.transform("_hits", lambda i: F.struct(F.get("_windows", i).alias("h"), i.alias("pos"), F.slice("_words", i + 1, k).alias("cut")))).alias("_hit"))
        .select("_doc", "_text_hash", F.col("_hit.h").alias("_h"), F.col("_hit.pos").alias("_pos"), F.col("_hit.cut").alias("_cut"))
    )


def _consistent(pairs: Column) -> Column:
    """Whether each value of the item stands for one value of the document."""
    return F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda x: x["mine"])))


_OWN = ["_doc", "_text_hash", "_item", "_n"]


def _leaks(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_doc").alias("doc_id"), "_text_hash", F.col("_item").alias("item_id"), (F.col("_covered") / F.col("_n")).alias("share"), F.col("_slots_met").cast("long").alias("n_slots"), F.when(F.col("_same"), "exact").otherwise("re-parameterised").alias("kind"))


def _template_leaks(docs: DataFrame, windows: DataFrame, n: int, doc_id: str, text: str, s: Settings) -> DataFrame:
    k = s.window
    words = docs.select(F.col(doc_id).alias("_doc"), F.xxhash64(text).alias("_text_hash"), tokens(F.col(text)).alias("_words"))
    found = _hits(words, _hashes(F.col("_words")), windows, n, k, s)
    met = found.join(F.broadcast(windows) if n <= MOST_BROADCAST else windows, "_h")
    both = F.arrays_zip("_slots", _slots(F.col("_cut")).alias("_own"))
    pair = lambda kind, x, y: F.struct(F.concat(F.lit(kind), x).alias("mine"), F.concat(F.lit(kind), y).alias("other"))
    values = F.transform(F.filter(both, lambda x: x["_slots"]["value"].isNotNull()), lambda x: pair(NUMBER, x["_slots"]["value"], x["_own"]["value"]))
    names = F.transform(F.filter(both, lambda x: (x["_slots"]["name"] != "") & (x["_own"]["name"] != "")), lambda x: pair(NAME, x["_slots"]["name"], x["_own"]["name"]))
    aligned = (
        met.groupBy(*_OWN, (F.col("_pos") - F.col("_at")).alias("_shift"))
        .agg(F.collect_set("_at").alias("_ats"), F.array_distinct(F.flatten(F.collect_set(F.concat(values, names)))).alias("_pairs"))
        .filter(_consistent(F.col("_pairs"))).withColumn("_alone", _covered(F.col("_ats"), k))
    )
    together = aligned.groupBy(*_OWN).agg(
        F.max("_alone").alias("_alone"), F.flatten(F.collect_list("_ats")).alias("_ats"), F.array_distinct(F.flatten(F.collect_list("_pairs"))).alias("_pairs"),
        F.max_by(F.col("_pairs"), F.struct("_alone", -F.abs("_shift"), "_shift")).alias("_best"),
    )
    agree = _consistent(F.col("_pairs"))
    chosen = together.withColumn("_covered", F.when(agree, _covered(F.array_distinct("_ats"), k)).otherwise(F.col("_alone"))).withColumn("_shown", F.when(agree, F.col("_pairs")).otherwise(F.col("_best")))
    return _leaks(chosen.filter(F.col("_covered") >= F.lit(s.min_share) * F.col("_n")).withColumn("_slots_met", F.size("_shown")).withColumn("_same", F.forall("_shown", lambda x: x["mine"] == x["other"])))


def _plain_leaks(docs: DataFrame, items: DataFrame, doc_id: str, text: str, s: Settings) -> DataFrame:
    """Exact copies of items that have no template windows."""
    k = s.window
    words = docs.select(F.col(doc_id).alias("_doc"), F.xxhash64(text).alias("_text_hash"), plain_tokens(F.col(text)).alias("_words"))
    plain = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    windows = (
        items.withColumn("_n", F.size("_words")).filter(F.col("_n") >= k).withColumn("_hashes", plain("_words"))
        .withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_n") - k))).select(_window_hash(F.col("_hashes"), F.col("_at"), k).alias("_h"), "_item", "_at", "_n")
    )
    n = windows.count()
    met = _hits(words, plain("_words"), windows, n, k, s).drop("_cut").join(F.broadcast(windows) if n <= MOST_BROADCAST else windows, "_h")
    long = met.groupBy(*_OWN).agg(_covered(F.collect_set("_at"), k).alias("_covered")).filter(F.col("_covered") >= F.lit(s.min_share) * F.col("_n"))
    short = items.filter(F.size("_words") < k).select("_item", F.size("_words").alias("_n"), F.xxhash64("_words").alias("_h"))
    same = words.filter(F.size("_words").between(1, k - 1)).select("_doc", "_text_hash", F.xxhash64("_words").alias("_h")).join(short, "_h").select(*_OWN, F.col("_n").alias("_covered")).distinct()
    return _leaks(long.unionByName(same).withColumns({"_slots_met": F.lit(0), "_same": F.lit(True)}))


def find_leaks(docs: DataFrame, bench: DataFrame, settings: Settings | None = None, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row (doc_id, _text_hash, item_id, share, n_slots, kind) per document and benchmark item found in it."""
    s = settings or Settings()
    windows = benchmark_windows(bench, item, item_text, s)
    found = _template_leaks(docs, windows, windows.count(), doc_id, text, s)
    items = plain_items(bench, windows, item, item_text)
    return found if items.isEmpty() else found.unionByName(_plain_leaks(docs, items, doc_id, text, s))


def decontaminate(docs: DataFrame, bench: DataFrame, settings: Settings | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those in which a benchmark item is found."""
    own, other = (next(n for n in (f"{base}{'_' * k}" for k in range(1000)) if n not in docs.columns) for base in ("_leak", "_leak_hash"))
    leaks = find_leaks(docs, bench, settings, doc_id, text).select(F.col("doc_id").alias(own), F.col("_text_hash").alias(other)).distinct()
    return docs.join(leaks, docs[doc_id].eqNullSafe(leaks[own]) & (F.xxhash64(docs[text]) == leaks[other]), "left_anti")


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("_text_hash")


#: Lookbehinds and sliding windows over tokens have no plain SQL; tests compare with brute force.
QUERIES = {"op7_template_decontamination": op7_template_decontamination}
