"""Identifier and text functions, full-text search and lexical signals.

Everything is built-in column functions and joins on terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.lineage import cut

COLUMNS = ("name", "qualified", "signature", "doc")
K1, B = 1.2, 0.75
#: The floor of an inverse document frequency.
LEAST_IDF = 1e-6
#: Rows that a task holds as Python strings at once, and entries that it counts before it passes them on.
SLICE, ENTRIES = 256, 100_000
_ACCENTS = (
    "àáâãäåāăąçćčďèéêëēęěìíîïīįñńňòóôõöøōőùúûüūůűýÿžźżšśŕřťţğłĺľ",
    "aaaaaaaaacccdeeeeeeeiiiiiinnnoooooooouuuuuuuyyzzzssrrttglll",
)


def split_identifier(c: Column | str) -> Column:
    """The words of an identifier: cut at case changes, ends of acronyms, and at _ - . : / and white space."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    c = F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    c = F.regexp_replace(c, r"[_\-.:/\s]+", " ")
    return F.filter(F.split(F.lower(F.trim(c)), " +"), lambda x: x != "")


def split_identifier_text(s: str) -> list[str]:
    """The same of a Python string."""
    s = re.sub("([a-z0-9])([A-Z])", r"\1 \2", s)
    s = re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", s)
    return re.sub(r"[_\-.:/\s]+", " ", s).strip().lower().split()


def normalize_identifier(c: Column | str) -> Column:
    return F.array_join(split_identifier(c), " ")


def escape_term(s: str) -> str:
    """A term without the signs that mean something in a full-text query."""
    return re.sub(r'["\\()\[\]*^:+-]', "", s)


def match_query(text: str) -> str:
    """A full-text query of prefix phrases that must all match."""
    return " AND ".join(f'"{t}"*' for t in (escape_term(x) for x in text.split()) if t)


def glob_to_like(glob: str) -> str:
    """A glob as a LIKE pattern: .* and * stand for any run, ? for one character."""
    return glob.replace("\\", "\\\\").replace(".*", "%").replace("*", "%").replace("?", "_")


def file_extension(c: Column | str) -> Column:
    return F.substring_index(c, ".", -1)


def prefix_segments(c: Column | str) -> Column:
    s = F.split(c, r"\.")
    return F.array_join(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), ".")


def fold_accents(c: Column) -> Column:
    return F.translate(c, *_ACCENTS)


def tokens(c: Column | str) -> Column:
    """Runs of letters and digits, small, without accents."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(fold_accents(F.lower(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def token_text(c: Column | str) -> Column:
    """The same as one string, tokens between spaces."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(fold_accents(F.lower(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+", " ")


def token_list(text: str) -> list[str]:
    folded = text.lower().translate(str.maketrans(*_ACCENTS))
    return [x for x in re.split(r"[\W_]+", folded) if x]


# Full-text search


def postings(nodes: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """(id, col, pos, term): the inverted index, one row per place."""
    fields = F.array(*[F.struct(F.lit(c).alias("col"), tokens(c).alias("terms")) for c in columns])
    each = nodes.select("id", F.explode(fields).alias("f"))
    return each.select("id", F.col("f.col").alias("col"), F.posexplode("f.terms").alias("pos", "term"))


def term_counts(nodes: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """(col, term, places, nodes): how often a term stands in a column, and in how many nodes.

    Each task adds up its nodes and passes on a row for a term and not for a
    place. Where ids repeat, which should not be, places are grouped by id.
    """
    if not nodes.groupBy("id").count().where("count > 1").isEmpty():
        index = postings(nodes, columns).groupBy("col", "term", "id").agg(F.count("*").alias("tf"))
        return index.groupBy("col", "term").agg(F.sum("tf").alias("places"), F.count("*").alias("nodes"))
    names = list(columns)

    def rows(places: Counter, texts: Counter) -> pa.RecordBatch:
        keys = list(places)
        data = [[names[i] for i, _ in keys], [t for _, t in keys], [places[k] for k in keys], [texts[k] for k in keys]]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i < 2 else pa.int64()) for i, x in enumerate(data)], names=["col", "term", "places", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, texts = Counter(), Counter()
        for batch in _slices(batches):
            for i, column in enumerate(batch.columns):
                for text in column.to_pylist():
                    found = Counter((i, t) for t in text.split(" ") if t)
                    places.update(found)
                    texts.update(found.keys())
                    if len(places) > ENTRIES:
                        yield rows(places, texts)
                        places, texts = Counter(), Counter()
        yield rows(places, texts)

    each = nodes.select(*[token_text(c).alias(c) for c in names]).mapInArrow(run, "col string, term string, places long, nodes long")
    return each.groupBy("col", "term").agg(F.sum("places").alias("places"), F.sum("nodes").alias("nodes"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE))


def doc_lengths(nodes: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """(id, len): tokens per node over all columns."""
    return nodes.select("id", sum((F.size(tokens(c)) for c in columns), F.lit(0)).cast("long").alias("len"))


def phrase_hits(index: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(id, f): places where the terms stand one after the other, the last as a prefix."""
    found = None
    for i, t in enumerate(terms):
        here = index.where(F.col("term").startswith(t) if i == len(terms) - 1 else F.col("term") == t).select("id", "col", (F.col("pos") - i).alias("at"))
        found = here if found is None else found.join(here, ["id", "col", "at"], "left_semi")
    return found.groupBy("id").agg(F.count("*").alias("f"))


def phrase_count(token_text: Column, terms: Sequence[str]) -> Column:
    """How often phrase_hits() finds the terms in a text of token_text() that starts with a space: at each place, also where two overlap."""
    return F.regexp_count(token_text, F.lit(f"(?= {' '.join(terms)})")).cast("long")


def bm25(nodes: DataFrame, text: str, columns: Sequence[str] = COLUMNS, index: DataFrame | None = None) -> DataFrame:
    """(id, score): nodes in which every word of the text matches as a prefix phrase, higher is better.

    Lengths and the number of nodes are those of all nodes given; a phrase's
    frequencies count prefix matches over all columns. Without an index each
    text is read once, where it lies: what is kept of a node is its length and
    frequencies.
    """
    phrases = [p for p in (token_list(escape_term(x)) for x in text.split()) if p]
    spark = nodes.sparkSession
    if not phrases:
        return spark.createDataFrame([], "id long, score double")
    found = [f"f{i}" for i in range(len(phrases))]
    if index is None:
        texts = nodes.select("id", *[F.concat(F.lit(" "), token_text(c)).alias(f"_{i}") for i, c in enumerate(columns)])
        total = lambda f: sum((f(F.col(f"_{i}")) for i in range(len(columns))), F.lit(0).cast("long"))
        length = total(lambda c: F.regexp_count(c, F.lit("[^ ]+")).cast("long"))
        out = cut(texts.select("id", length.alias("len"), *[total(lambda c, p=p: phrase_count(c, p)).alias(f) for f, p in zip(found, phrases, strict=True)]))
    else:
        out = doc_lengths(nodes, columns)
        for f, p in zip(found, phrases, strict=True):
            out = out.join(phrase_hits(index, p).withColumnRenamed("f", f), "id", "left")
    stats = out.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *[F.count_if(F.col(f) > 0).alias(f"n{i}") for i, f in enumerate(found)])
    # one row
    out = out.where(" AND ".join(f"{f} > 0" for f in found)).join(F.broadcast(stats), F.lit(True))
    score = F.lit(0.0)
    for i in range(len(phrases)):
        n, f = F.col(f"n{i}"), F.col(f"f{i}")
        idf = F.greatest(F.log((F.col("n") - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return out.select("id", score.alias("score"))


def like_fallback(nodes: DataFrame, text: str) -> DataFrame:
    """(id, score): substring matches; 3 for each shared word of the name's identifiers, 5 if the text stands in the name."""
    q = text.strip().lower()
    words = list(dict.fromkeys(split_identifier_text(text)))
    pattern = "%" + re.sub(r"\s+", "%", q).replace("\\", "\\\\") + "%"
    hit = F.lit(False)
    for c in COLUMNS:
        hit = hit | F.coalesce(F.lower(c).like(pattern), F.lit(False))
    own = split_identifier(F.concat_ws(" ", "name", "qualified"))
    shared = F.size(F.array_intersect(own, F.array(*[F.lit(w) for w in words]).cast("array<string>")))
    score = 3 * shared + F.when(F.array_join(split_identifier("name"), " ").contains(" ".join(words)), 5).otherwise(0)
    return nodes.where(hit).select("id", score.cast("double").alias("score"))


def search_text(nodes: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """(id, rank, score, source): BM25 hits first, then substring matches that aren't among them."""
    a = bm25(nodes, text).withColumn("source", F.lit("bm25"))
    b = like_fallback(nodes, text).join(a.select("id"), "id", "left_anti").withColumn("source", F.lit("like"))
    both = a.unionByName(b).orderBy(F.col("source"), F.desc(F.round("score", 9)), "id").limit(limit)
    w = Window.orderBy("source", F.desc(F.round("score", 9)), "id")  # over `limit` rows
    return both.withColumn("rank", F.row_number().over(w)).select("id", "rank", "score", "source")


# Lexical signals


def corpus_tokens(nodes: DataFrame, *more: Column) -> DataFrame:
    """(id, terms): identifier words of name, qualified name, signature and doc, longer than one letter; and more columns."""
    terms = split_identifier(F.concat_ws(" ", "name", "qualified", "signature", "doc"))
    return nodes.select("id", F.filter(terms, lambda x: F.length(x) > 1).alias("terms"), *more)


def doc_frequency(corpus: DataFrame) -> DataFrame:
    return corpus.select("id", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(corpus: DataFrame) -> DataFrame:
    """(term, df, idf): ln((N + 1) / (df + 1)) + 1."""
    n = corpus.agg(F.count("*").alias("n"))
    return doc_frequency(corpus).join(F.broadcast(n), F.lit(True)).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def _with_tfidf(corpus: DataFrame, words: Sequence[str]) -> DataFrame:
    """corpus without its terms, with `tfidf`, null where none of the words occurs, and `shared`: how many of them do over those of the smaller set.

    The terms of a node are counted once, in one pass over the corpus; what is
    kept of them is the words' and the greatest count. What meets every node is
    one row: N and the words' df.
    """
    asked = list(dict.fromkeys(words))
    kept = [c for c in corpus.columns if c != "terms"]
    counts = [f"_tf{i}" for i in range(len(asked))]
    rows = corpus.select(*kept, F.array_join("terms", " ").alias("_terms"))
    out = StructType([*rows.schema.fields[:-1], *[StructField(c, IntegerType()) for c in (*counts, "_most", "_kinds")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            made = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                n = Counter(text.split(" ")) if text else Counter()
                made.append([*(n[w] for w in asked), max(n.values(), default=0), len(n)])
            arrays = [pa.array(x, pa.int32()) for x in zip(*made, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=out.names)

    rows = cut(rows.mapInArrow(run, out))
    stats = rows.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c) > 0).alias(f"_df{i}") for i, c in enumerate(counts)])
    weight, hits = F.lit(0.0), F.lit(0)
    for i, w in enumerate(asked):
        weight = weight + F.lit(words.count(w)) * F.col(counts[i]) / F.col("_most") * (F.log((F.col("_n") + 1) / (F.col(f"_df{i}") + 1)) + 1)
        hits = hits + (F.col(counts[i]) > 0).cast("int")
    smaller = F.greatest(F.lit(1), F.least(F.lit(len(asked)), F.col("_kinds")))
    return rows.join(F.broadcast(stats), F.lit(True)).select(*kept, F.when(hits > 0, weight).alias("tfidf"), (hits / smaller).alias("shared"))


def query_words(text: str) -> list[str]:
    return [w for w in split_identifier_text(text) if len(w) > 1]


def tfidf(corpus: DataFrame, text: str) -> DataFrame:
    """(id, tfidf): for each word of the text, repeats too, tf / greatest tf of the node * idf. Nodes without any are left out.

    No term of the corpus is shuffled.
    """
    return _with_tfidf(corpus, query_words(text)).where("tfidf IS NOT NULL").select("id", "tfidf")


def module_proximity(query_module: Column, qualified: Column) -> Column:
    """Common leading segments over the shorter of the query's module and the node's."""
    q, d = F.split(query_module, r"\."), F.split(qualified, r"\.")
    d = F.slice(d, 1, F.greatest(F.size(d) - 1, F.lit(0)))
    same = F.zip_with(q, d, lambda a, b: F.coalesce(a == b, F.lit(False)))
    common = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])
    return common / F.greatest(F.lit(1), F.least(F.size(q), F.size(d)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if both are empty or one is null."""
    n = F.size(F.array_union(a, b))
    return F.coalesce(F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0), F.lit(0.0))


SIGNALS = ("tfidf", "proximity", "signature", "profile")
WEIGHTS = {"tfidf": 0.30, "proximity": 0.15, "signature": 0.10, "profile": 0.05}


def signals(nodes: DataFrame, text: str, project: str) -> DataFrame:
    """(id, tfidf, proximity, signature, profile) of every node."""
    words = query_words(text)
    q = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    about = (module_proximity(F.lit(project), F.col("qualified")).alias("proximity"), jaccard(q, split_identifier("signature")).alias("signature_overlap"))
    corpus = corpus_tokens(nodes, *about)
    return _with_tfidf(corpus, words).select("id", F.coalesce("tfidf", F.lit(0.0)).alias("tfidf"), "proximity", F.col("signature_overlap").alias("signature"), F.col("shared").alias("profile"))


def normalize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns scaled from least to greatest onto 0 to 1; equal values become 0."""
    bounds = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(F.broadcast(bounds), F.lit(True))
    for c in columns:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        out = out.withColumn(c, (F.col(c) - F.col(f"_lo_{c}")) / F.when(span == 0, 1.0).otherwise(span))
    return out.select(df.columns)


def combine(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, signal): the weighted sum of the signals."""
    w = WEIGHTS | (weights or {})
    return df.select("id", sum((F.col(c) * F.lit(w[c]) for c in SIGNALS), F.lit(0.0)).alias("signal"))
