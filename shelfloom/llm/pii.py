"""Personal data: fixed patterns, and terms that disclose an entity by what the corpus says of them.

Base spans come from four patterns. An entity is a pattern's value; its terms are the words of the
documents that hold it, wherever they stand. With documents as the unit, a term t discloses entity e to
the degree PMI(e; t) / IC(e), which is 1 when t occurs only with e. Terms above one threshold are
generalised, above a second one removed. So an entity of one document among N is disclosed by those of its
words that at most N**0.25 documents have. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import staged, unused

LOCAL = "[A-Za-z0-9._%+-]"
#: Fixed kinds, in the order of the output, with patterns that never rescan a run of characters: a match
#: starts where its run starts or where the last match ended, and no part gives back what it took.
PATTERNS = (
    ("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
NAMES = [k for k, _, _ in PATTERNS] + ["term"]
OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
#: A run of letters that touches no other letter or digit.
TERM = r"(?<![\p{L}\p{N}])\p{L}{3,}(?![\p{L}\p{N}])"
#: Candidate terms are looked for by the low bits of their hash: at most this many rows are broadcast.
BUCKETS = 1 << 20


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    value = lambda i: F.substring(back, i, F.lit(1)).try_cast("int")
    twice = lambda i: value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, twice(i)).otherwise(value(i))) % 10 == 0


def _valid(kind: Column, hit: Column) -> Column:
    card, digits = F.regexp_replace(hit, "[ -]", ""), F.length(F.regexp_replace(hit, "[^0-9]", ""))
    return (
        F.when(kind == 1, F.regexp_like(hit, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$")))
        .when(kind == 2, F.when(F.length(card).between(12, 19), _luhn(card)).otherwise(False))
        .when(kind == 3, digits.between(9, 15))
        .otherwise(True)
    )


def find(docs: DataFrame) -> DataFrame:
    """One row per match in docs (doc_id, text), one of nulls for a document without any.

    Columns: rid (a number for the row of docs), doc_id, copy (hash of the text), kind (place in NAMES),
    start, end (code points, end exclusive), hit, valid.
    """
    text, arrays = F.coalesce("text", F.lit("")), []
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    none = F.array().cast("array<string>")
    part = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x["hit"].alias("hit"), F.length(x["gap"]).alias("gap"))
    for k, (_, pattern, sign) in enumerate(PATTERNS):
        may = F.contains("text", F.lit(sign)) if sign else F.regexp_like("text", F.lit("[0-9][0-9 -]{10}"))
        if k == 1:
            may = F.regexp_like("text", F.lit(r"[0-9]\.[0-9]"))
        rows = rows.withColumns({f"hits{k}": F.when(may, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)})
        rows = rows.withColumns({f"gaps{k}": F.when(F.size(f"hits{k}") > 0, F.split("text", pattern, -1)).otherwise(none)})
        arrays.append(F.transform(F.arrays_zip(F.col(f"hits{k}").alias("hit"), F.col(f"gaps{k}").alias("gap")), part(k)))
    parts = rows.select("rid", "doc_id", _copy(F.col("text")), F.concat(*arrays).alias("found"))
    parts = parts.select("rid", "doc_id", "copy", F.posexplode_outer("found").alias("n", "x")).select("rid", "doc_id", "copy", "n", "x.*")
    order = Window.partitionBy("rid", "kind").orderBy("n")
    upto = F.sum(F.col("gap") + F.coalesce(F.length("hit"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("end", upto).where("hit is not null or n is null")
    return parts.select(
        "rid", "doc_id", "copy", "kind", (F.col("end") - F.length("hit")).alias("start"), "end", "hit",
        F.when(F.col("hit").isNotNull(), _valid(F.col("kind"), F.col("hit"))).alias("valid"),
    )


def _copy(text: Column) -> Column:
    """The key of a text, which its exact copies share."""
    return F.xxhash64(text).alias("copy")


def _outside(text: Column) -> Column:
    """The text with blanks for e-mail addresses, whose parts are no terms; places stay as they are."""
    pattern = PATTERNS[0][1]
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    blank = F.transform(parts, lambda x: F.concat(x["gap"], F.repeat(F.lit(" "), F.coalesce(F.length(x["hit"]), F.lit(0)))))
    return F.when(F.contains(text, F.lit("@")), F.array_join(blank, "")).otherwise(text)


def _words(text: Column) -> Column:
    """The different terms of a text, lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_outside(text), F.lit(TERM), F.lit(0)), F.lower))


def _places(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every occurrence of the wanted (copy, term) in texts (copy, text; one row a copy): copy, term, start, end."""
    rows = texts.select("copy", _outside(F.col("text")).alias("text"))
    words, gaps = F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.split("text", TERM, -1)
    part = lambda x: F.struct(F.lower(x["word"]).alias("term"), F.length(x["word"]).alias("size"), F.length(x["gap"]).alias("gap"))
    rows = rows.select("copy", F.posexplode(F.transform(F.arrays_zip(words.alias("word"), gaps.alias("gap")), part)).alias("n", "x")).where("x.term is not null")
    upto = Window.partitionBy("copy").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("copy", "n", "x.*").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto))
    return rows.join(wanted, ["copy", "term"]).withColumn("start", F.col("end") - F.col("size")).drop("n", "size", "gap")


def disclosing_terms(docs: DataFrame, hits: DataFrame, least_texts: int = 1, generalise: float = 0.75, remove: float = 0.9) -> DataFrame:
    """Spans of terms, in documents with a valid hit, whose disclosure of it reaches a threshold: rid, doc_id, start, end, term, disclosure, action.

    Document frequencies are over all of docs. A pair counts only if least_texts different texts have it: more
    than 1 asks for repeated evidence, and then values of a single text are disclosed by nothing. Every
    occurrence in a document that holds the entity gets a span.
    """
    total = docs.count()
    text = docs.where("text is not null").select(_copy(F.col("text")), "text")
    held = hits.where("valid").select("rid", "copy", F.struct("kind", F.lower("hit")).alias("entity")).distinct()
    held = held.groupBy("entity", "copy").agg(F.count("*").alias("n"))
    entities = held.groupBy("entity").agg(F.sum("n").alias("with_entity"), F.count("*").alias("texts")).where(F.col("texts") >= least_texts).drop("texts")
    held = staged(held.join(entities, "entity"), "held")
    # copies of a text have the same terms: each text counts once, for as many documents as have it
    copies = held.groupBy("copy").agg(F.max("n").alias("n"))
    terms = text.join(copies.select("copy"), "copy", "left_semi").select("copy", F.explode(_words(F.col("text"))).alias("term")).distinct()
    terms = staged(terms.join(copies, "copy"), "terms")
    pairs = held.join(terms.drop("n"), "copy").groupBy("entity", "term").agg(F.sum("n").alias("together"), F.count("*").alias("texts"), F.first("with_entity").alias("with_entity"))
    # a term that stands in this many documents with entities already has too many for its pair's threshold
    seen = terms.groupBy("term").agg(F.sum("n").alias("seen"))
    limit = F.col("together") * F.pow(F.lit(float(total)) / F.col("with_entity"), F.lit(1 - generalise))
    pairs = pairs.where(F.col("texts") >= least_texts).join(seen, "term").where(F.col("seen") <= limit * 1.000001)
    pairs = staged(pairs.drop("seen", "texts"), "pairs")
    buckets = pairs.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).alias("bucket")).distinct()
    corpus = text.select(F.explode(_words(F.col("text"))).alias("term")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)))
    corpus = corpus.join(F.broadcast(buckets), "bucket", "left_semi").groupBy("term").agg(F.count("*").alias("with_term"))
    scored = pairs.join(corpus, "term")
    pmi = F.log2(F.lit(float(total)) * F.col("together") / (F.col("with_entity") * F.col("with_term")))
    scored = scored.withColumn("disclosure", F.when(F.col("with_entity") < total, pmi / -F.log2(F.col("with_entity") / F.lit(float(total)))).otherwise(0.0))
    scored = scored.where(F.col("disclosure") >= generalise).select("entity", "term", "disclosure")
    found = held.select("entity", "copy").join(scored, "entity").join(terms.select("copy", "term"), ["copy", "term"])
    found = staged(found.groupBy("copy", "term").agg(F.max("disclosure").alias("disclosure")), "found")
    texts = text.join(found.select("copy").distinct(), "copy", "left_semi").groupBy("copy").agg(F.first("text").alias("text"))
    spans = hits.where("valid").select("rid", "doc_id", "copy").distinct().join(_places(texts, found), "copy").drop("copy")
    return spans.withColumn("action", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise"))


def find_personal_data(docs: DataFrame, least_texts: int = 1, generalise: float = 0.75, remove: float = 0.9) -> DataFrame:
    """Every row of docs with its spans: doc_id, base (array of spans of the patterns), spans (base and terms).

    Terms are judged as disclosing_terms says. A span is struct<start, kind, end, name, action>. A null text counts as empty and has none; rows that
    repeat have the same spans each; an empty table gives an empty one. Extra columns are ignored.
    """
    hits = staged(find(docs), "hits")
    terms = disclosing_terms(docs, hits, least_texts, generalise, remove)
    kinds = F.array(*map(F.lit, NAMES))
    span = lambda action: F.struct("start", "kind", "end", F.element_at(kinds, F.col("kind") + 1).alias("name"), action.alias("action"))
    base = hits.select("rid", "doc_id", F.when(F.col("valid"), span(F.lit("replace"))).alias("span"))
    more = terms.withColumn("kind", F.lit(len(PATTERNS))).select("rid", "doc_id", span(F.col("action")).alias("span"))
    every = base.union(more).groupBy("rid").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_list("span")).alias("spans"))
    return every.select("rid", "doc_id", F.filter("spans", lambda x: x["kind"] < len(PATTERNS)).alias("base"), "spans")


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["start"], x["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{n}") for k, n in enumerate(NAMES[:-1])),
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (doc_id unique) with text in which spans are replaced: [EMAIL] and so on, [TERM] for generalised terms, nothing for removed ones.

    A span that starts inside an earlier one is covered by it. A null text becomes an empty one; documents
    that `found` doesn't have keep their text, and columns of any name stay as they are.
    """
    own, marks = unused("own", docs.columns), unused("marks", docs.columns)
    text = F.coalesce(F.col("text"), F.lit(""))
    put = lambda x: F.when(x["action"] == "remove", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(x["name"]), F.lit("]")))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda s, x: F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))).otherwise(
        F.struct(x["end"].alias("at"), F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), put(x)).alias("out"))
    )
    end = lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
    spans = found.select(F.col("doc_id").alias(own), F.col("spans").alias(marks))
    rows = docs.join(spans, docs["doc_id"].eqNullSafe(spans[own]), "left")
    return rows.withColumn("text", F.aggregate(F.coalesce(marks, F.array().cast(found.schema["spans"].dataType)), begin, step, end)).select(*docs.columns)
