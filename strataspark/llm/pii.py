"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Matches of the base patterns are the protected entities, on three levels: the value itself, its kind, and personal data
of any kind. Words that stand in a text with an entity may give it away: over the distinct texts of the whole corpus, the
pointwise mutual information of word and entity is compared with the information content of the entity (after Sanchez
and Batet, 2016). A word whose share of it is DISCLOSURE or more, and that stands with the entity in more texts than
chance explains, is generalised wherever it stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, documents, durable, fresh, lookup, sized, small, stored
from .exact_dedup import key_filter, maybe_repeated

KINDS = ("email", "ip", "card", "phone")
#: Java forms of the base patterns. Possessive repeats and "at the start of a run, or where the last match ended" (\G)
#: find the same matches in linear time and without deep recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_IP = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"
#: Least length of a word; share of the entity's information from which a word discloses it; bound on the chance that any
#: word at all is tied to an entity by accident.
LETTERS, DISCLOSURE, ERROR = 4, 0.8, 0.005
#: Factors that the bound on the chance of a pair has at most.
FACTORS = 50
#: Names of columns that steps on the way give to what they add.
RESERVED = ("_text", "_key", "_spans", "_found", "_terms", "_null", "_h", "_maybe", "_bucket", "_bits", "_byte", "_at")
_WORD = r"\p{L}{%d,40}"
_SPAN = "struct<kind:string,start:int,end:int>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(F.reverse(digits), i, F.lit(1)).cast("int")).otherwise(
            F.substring(F.lit("0246813579"), F.substring(F.reverse(digits), i, F.lit(1)).cast("int") + 1, F.lit(1)).cast("int")
        ),
    )
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(_IP)
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def spans_of(text: Column, kind: str, pattern: str, hint: Column) -> Column:
    """Array of (kind, start, end) of the valid matches, in code points. `hint` is false only where there is none.

    The texts between matches give the places: a match begins where what is before it ends."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sizes = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), found.alias("match"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{_SPAN}>)").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["match"].isNotNull() & valid(kind, x["match"]), F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    located = F.aggregate(sizes, start, step)["spans"]
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    return F.when(hint & text.rlike(pattern), located).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    dots = text.rlike(r"[0-9]\.[0-9]")
    hints = {"email": text.contains("@"), "ip": dots, "card": text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), "phone": text.rlike(r"\+[0-9]")}
    return {kind: spans_of(text, kind, PATTERNS[kind], hints[kind]) for kind in KINDS}


def _cut(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_WORD % LETTERS), F.lit(0)))


def chance(total: float, n_both: Column, n_term: Column, n_entity: Column) -> Column:
    """Log of an upper bound on the chance that a term and an entity strewn over `total` texts meet in `n_both` or more.

    The lesser of C(n_term, j) C(n_entity, j) / C(total, j), j = min(n_both, FACTORS), which is exact if the rarer of
    the two is always with the other, and Hoeffding's bound exp(-n_term KL(n_both / n_term, n_entity / total))."""
    n, k, t, e = F.lit(float(total)), n_both.cast("double"), n_term.cast("double"), n_entity.cast("double")
    each = lambda acc, i: acc + F.log((t - i) * (e - i) / ((n - i) * (i + 1)))
    subsets = F.aggregate(F.sequence(F.lit(0), F.least(n_both, F.lit(FACTORS)).cast("int") - 1), F.lit(0.0), each)
    q, p = k / t, e / n
    rest = F.when((q < 1) & (p < 1), (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    return F.least(subsets, F.when(q > p, -t * (q * F.log(q / p) + rest)).otherwise(0.0), F.lit(0.0))


def divided(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` whose _key is in none of the rows of `keys` (_key; durable), and those where it may be.

    A Bloom filter of the keys tells, so that only texts that may have a partner are shuffled to meet it."""
    bitmaps, bits = key_filter(durable(keys.select(F.xxhash64("_key").alias("h"))))
    marked = maybe_repeated(rows.withColumn("_h", F.xxhash64("_key")), "_maybe", (durable(bitmaps), bits)).drop("_h")
    return marked.where("not _maybe").drop("_maybe"), marked.where("_maybe").drop("_maybe")


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """`rows` whose _key is not in `keys` (_key; durable)."""
    if small(keys):
        return rows.join(F.broadcast(keys), "_key", "left_anti")
    clear, rest = divided(rows, keys)
    return clear.unionByName(rest.join(keys, "_key", "left_anti"))


def disclosing_terms(rows: DataFrame, disclosure: float = DISCLOSURE, error: float = ERROR) -> DataFrame:
    """(term, entity_kind, share): words that give away an entity of `rows` (_key, _text, _spans); one row a word, its largest share.

    An entity is a value, a kind, or any personal data at all (entity_kind `any`).
    PMI(word, entity) / IC(entity) = log(N n_both / (n_word n_entity)) / log(N / n_entity), with counts of distinct
    texts, wherever in the text the word stands, but for addresses. Copies of one text are one observation, and one says
    nothing of what goes with what: a pair must be met in two texts at least, and its chance, times the number of words
    that could be met twice, be at most `error`. Words too common for any share of `disclosure` with an entity (n_both is
    at most n_entity) are left out before words and entities are paired."""
    texts = rows.select("_key", F.xxhash64("_text").alias("text"))
    first = durable(texts.groupBy("text").agg(F.min("_key").alias("_key")))
    total = float(max(2, first.count()))
    copies = durable(texts.select("_key").join(first.select("_key"), "_key", "left_anti"))
    once = without(rows, copies)
    hit = without(rows.where(F.size("_spans") > 0), copies).select("_key", "_text", F.explode("_spans").alias("s"))
    entity = F.concat(F.col("s.kind"), F.lit(":"), F.when(F.col("s.kind") == "email", F.lower(_cut(F.col("_text"), F.col("s")))).when(F.col("s.kind") == "ip", _cut(F.col("_text"), F.col("s"))).otherwise(_digits(_cut(F.col("_text"), F.col("s")))))
    levels = F.array(*[F.struct(F.xxhash64(e).alias("entity"), k.alias("kind")) for e, k in ((entity, F.col("s.kind")), (F.concat(F.lit("kind:"), F.col("s.kind")), F.col("s.kind")), (F.lit("any:"), F.lit("any")))])
    places = durable(hit.select("_key", F.explode(levels).alias("l")).select("_key", "l.*").distinct())
    entities = durable(places.groupBy("entity").agg(F.count_distinct("_key").alias("n_entity")).where("n_entity >= 2"))
    nothing = rows.sparkSession.createDataFrame([], "term string, entity_kind string, share double")
    if entities.isEmpty():
        return nothing
    places = durable(lookup(places, entities, "entity", F.col("n_entity") >= max(1000, int(total * HOT_SHARE))))
    # Only addresses have letters; they are entities themselves, not words that go with one.
    outside = F.when(F.col("_text").contains("@"), F.regexp_replace("_text", PATTERNS["email"], " ")).otherwise(F.col("_text"))
    counts = once.select(F.explode(_words(outside)).alias("w")).groupBy(F.xxhash64("w").alias("word")).agg(F.count("*").alias("n_term"))
    counts = durable(counts.where("n_term >= 2"))
    tried = max(1, counts.count())
    # log(N k / (t e)) >= d log((N + 1) / e), k <= e: t <= N (e / (N + 1)) ** d
    most = total * F.pow(F.col("n_entity") / (total + 1), F.lit(disclosure)) * (1 + 1e-9)
    reach = durable(places.groupBy("_key").agg(F.max(most).alias("most")))
    near = rows.where(F.size("_spans") > 0).join(sized(reach), "_key").select("_key", "most", F.explode(_words(outside)).alias("term"))
    near = near.withColumn("word", F.xxhash64("term"))
    near = lookup(near, counts, "word", F.col("n_term") >= max(2, int(total * HOT_SHARE))).where(F.col("n_term") <= F.col("most"))
    pairs = places.join(near.select("_key", "term", "n_term"), "_key").where(F.col("n_term") <= most)
    pairs = pairs.groupBy("entity", "kind", "term").agg(F.count("*").alias("n_both"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity")).where("n_both >= 2")
    share = F.log(total * F.col("n_both") / (F.col("n_term") * F.col("n_entity"))) / F.log((total + 1) / F.col("n_entity"))
    by_chance = chance(total, F.col("n_both"), F.col("n_term"), F.col("n_entity")) + F.log(F.lit(float(tried)))
    found = pairs.withColumn("share", share).where((F.col("share") >= disclosure) & (by_chance <= F.log(F.lit(error))))
    return durable(found.groupBy("term").agg(F.max_by("kind", "share").alias("entity_kind"), F.max("share").alias("share")))


def term_documents(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(_key, term) for each document of `rows` and each of the `terms` (t) in it. No terms: nothing is scanned."""
    if terms.isEmpty():
        return rows.select("_key", F.lit("").alias("term")).where(F.lit(False))
    return rows.select("_key", F.explode(_words(F.col("_text"))).alias("term")).join(sized(terms), F.col("term") == F.col("t"), "left_semi")


def _term_spans(text: Column, terms: Column) -> Column:
    """Spans of the words of `text` that are among `terms` (lower case)."""
    pattern = _WORD % LETTERS
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sizes = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), found.alias("match"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{_SPAN}>)").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(F.lit("term").alias("kind"), begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.coalesce(F.array_contains(terms, F.lower(x["match"])), F.lit(False)), F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(sizes, start, step)["spans"]


def find(docs: DataFrame, text_col: str = "text", **options) -> tuple[DataFrame, DataFrame]:
    """(`docs` with a column _found, the disclosing terms). _found: one array of spans for each base kind, then `term`.

    Every row is a document; a null text counts as empty and has no spans. Ids are not read. Extra columns pass
    through, whatever their names, but for those in RESERVED, which are replaced. An empty
    table gives an empty result. The text is stored once, however many columns show it."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    each = base_spans(F.col("_text"))
    kept = [c for c in docs.columns if c.lower() not in RESERVED]
    own = [c for c in kept if c != text_col or docs.schema[c].dataType.typeName() != "string"]
    rows = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text_col}`").isNull().alias("_null"), text.alias("_text")).withColumn("_found", F.struct(*[v.alias(k) for k, v in each.items()]))
    rows = stored(rows.withColumn("_key", F.monotonically_increasing_id()))
    slim = rows.select("_key", "_text", F.concat(*[F.col(f"_found.{k}") for k in KINDS]).alias("_spans"))
    terms = disclosing_terms(slim, **options)
    hits = term_documents(slim, terms.select(F.col("term").alias("t")))
    if terms.isEmpty():
        with_terms = rows.withColumn("_terms", F.expr("cast(null as array<string>)"))
    else:
        hits = durable(hits.groupBy("_key").agg(F.collect_set("term").alias("_terms")))
        clear, rest = divided(rows, hits.select("_key"))
        with_terms = clear.withColumn("_terms", F.expr("cast(null as array<string>)")).unionByName(rest.join(hits, "_key", "left"))
    extra = F.when(F.col("_terms").isNotNull(), _term_spans(F.col("_text"), F.col("_terms"))).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))
    found = F.struct(*[F.col(f"_found.{k}").alias(k) for k in KINDS], extra.alias("term")).alias("_found")
    shown = [F.col(f"`{c}`") if c in own else F.when(~F.col("_null"), F.col("_text")).alias(c) for c in kept]
    return with_terms.select(*shown, "_key", "_null", "_text", found), terms


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """`docs` with every span of `text_col` generalised to its kind, like [EMAIL]; a null text stays null.

    Spans that overlap are one, under the name of the first (the longer, if two begin together)."""
    mark = fresh(docs, "_whole")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows, _ = find(docs.select(F.struct(F.lit(0).alias(fresh(docs, "_none")), *others).alias(mark), F.col(f"`{text_col}`").alias("_input")), "_input", **options)
    everything = F.concat(*[F.col(f"_found.{k}") for k in (*KINDS, "term")])
    ordered = F.array_sort(F.transform(everything, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"))))
    text = F.col("_text")
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        fits = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], -s["last"]).alias("at"), F.when(fits, F.array_append(acc["parts"], piece)).otherwise(acc["parts"]).alias("parts"))

    done = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    clean = F.when(F.col("_null"), F.lit(None)).when(F.size(everything) == 0, text).otherwise(done)
    columns = [clean.alias(c) if c == text_col else F.col(mark)[c].alias(c) for c in docs.columns]
    return rows.select(*columns)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = find(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.concat(*[F.col(f"_found.{k}") for k in KINDS])
    everything = F.concat(base, F.col("_found.term"))
    counts = [F.size(F.col(f"_found.{k}")).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(everything).alias("spans"))


QUERIES = {"op6_pii": op6_pii}
ORACLES: dict[str, str] = {}
