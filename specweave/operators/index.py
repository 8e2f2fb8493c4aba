"""Inverted index: postings, document lengths, term counts."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.functions import text as tx
from specweave.workspace import Workspace, size_of

VARIANTS = ("raw", "norm", "oracle")


@dataclass
class Index:
    """Written tables, in folders by ``field``.

    docs (field, doc_id, len) · tokens (field, doc_id, tokens) · postings (field, term, doc_id, tf, len) · terms (field, term, df).
    Postings carry the document's length, which spares a join as wide as the postings.
    """

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    tokens: DataFrame
    ws: Workspace
    name: str
    seconds: float = 0.0
    version: int = 0
    plain: bool = False  # how texts were tokenized, and queries are

    def refresh(self) -> None:
        """Counts terms anew from the postings, and swaps the table in when it is whole."""
        old = self._terms_table()
        self.version += 1
        fresh = self.ws.stage(term_counts(self.postings).sortWithinPartitions("field", "term"), self._terms_table(), by="field")
        self.terms = fresh.select("field", "term", "df")
        self.ws.drop(old)

    def _terms_table(self) -> str:
        return f"{self.name}-terms{self.version}"

    def size(self) -> dict[str, int]:
        """Bytes of each table."""
        names = {"tokens": f"{self.name}-tokens", "postings": f"{self.name}-postings", "terms": self._terms_table()}
        return {k: size_of(self.ws.spark, f"{self.ws.path}/{v}") for k, v in names.items()}

    def drop(self) -> None:
        """Removes the tables; frames that read them fail afterwards."""
        self.ws.drop(f"{self.name}-tokens", f"{self.name}-postings", self._terms_table())


def build_index(texts: DataFrame, ws: Workspace, latin: bool = False, name: str = "index", plain: bool = False) -> Index:
    """From (field, doc_id, text). Each text is tokenized once, into a written table.

    Lengths are taken before the tokens are exploded, so documents without
    tokens count among the documents. Postings are sorted by term within files,
    so look-ups skip row groups. A text that is null has length 0, or none where
    tokens are ``plain``.
    """
    began = time.perf_counter()
    found = tx.tokenize(F.col("text"), latin, plain=plain)
    found = found if plain else F.coalesce(found, F.array().cast("array<string>"))
    tokens = texts.select("field", "doc_id", found.alias("tokens")).withColumn("len", F.array_size("tokens"))
    tokens = ws.stage(tokens, f"{name}-tokens", by="field")
    docs = tokens.select("field", "doc_id", "len")
    postings = ws.stage(term_frequencies(tokens).sortWithinPartitions("field", "term"), f"{name}-postings", by="field")
    terms = ws.stage(term_counts(postings).sortWithinPartitions("field", "term"), f"{name}-terms0", by="field")
    names = {"postings": ["field", "term", "doc_id", "tf", "len"], "terms": ["field", "term", "df"]}
    return Index(docs, postings.select(names["postings"]), terms.select(names["terms"]), tokens.select("field", "doc_id", "tokens"), ws, name, time.perf_counter() - began, plain=plain)


def term_frequencies(tokens: DataFrame) -> DataFrame:
    """(field, term, doc_id, tf, len) from (field, doc_id, tokens, len).

    A text's terms are counted in its row, as runs of its sorted tokens, so that
    no posting is shuffled. Only texts that share an identifier, or have none,
    are grouped.
    """
    shared = tokens.groupBy(F.col("field").alias("f"), F.col("doc_id").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR d IS NULL")
    if shared.isEmpty():
        return _in_rows(tokens)
    same = (F.col("field") == F.col("f")) & F.col("doc_id").eqNullSafe(F.col("d"))
    several = tokens.join(shared, same, "left_semi").select("field", "doc_id", "len", F.explode("tokens").alias("term"))
    grouped = several.groupBy("field", "term", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("len").alias("len"))
    return _in_rows(tokens.join(shared, same, "left_anti")).unionByName(grouped)


def _in_rows(tokens: DataFrame) -> DataFrame:
    """Term frequencies where each row is a document."""
    starts = F.filter(F.transform("sorted", lambda t, i: F.when((i == 0) | (t != F.get("sorted", i - 1)), i)), lambda i: i.isNotNull())
    runs = F.transform("starts", lambda at, n: F.struct(F.get("sorted", at).alias("term"), (F.coalesce(F.get("starts", n + 1), F.size("sorted")) - at).alias("tf")))
    rows = tokens.select("field", "doc_id", "len", F.sort_array("tokens").alias("sorted")).withColumn("starts", starts)
    # an inner explode would have its input computed once more, by the filter that is inferred from it
    rows = rows.select("field", "doc_id", "len", F.explode_outer(runs).alias("run")).where("run IS NOT NULL")
    return rows.select("field", "run.term", "doc_id", "run.tf", "len")


def term_counts(postings: DataFrame) -> DataFrame:
    """Documents of each term: the materialised view; writing it anew refreshes it."""
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def stacked(docs: DataFrame, id: str, variants: dict[str, Column]) -> DataFrame:
    """(field, doc_id, text): a row for each variant of the text, from one scan."""
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("text")) for k, v in variants.items()])
    return docs.select(F.col(id).alias("doc_id"), F.explode(pairs).alias("v")).select("v.field", "doc_id", "v.text")


def sheet_texts(sheets: DataFrame, extractions: DataFrame) -> DataFrame:
    """Sheets joined with extractions: id, category (as extracted), title, texts of the three variants, attributes."""
    raw = tx.raw_text(F.col("title"), F.col("rows"))
    found = extractions.select("id", F.col("mapping.category").alias("found"), "attributes")
    both = sheets.join(found, "id").withColumn("raw", raw)
    norm = F.concat(F.col("raw"), F.lit("\n"), tx.canonical_text(F.col("found"), F.col("attributes")))
    oracle = F.concat(F.col("raw"), F.lit("\n"), tx.canonical_text(F.col("category"), F.col("truth")))
    return both.select("id", F.col("found").alias("category"), "title", "raw", norm.alias("norm"), oracle.alias("oracle"), "attributes")
