"""One object over a catalog's tables, with an operation for each thing that can be asked of it.

Tables are DataFrames and never change: operations that write return a library with a new table of books. Everything
but ``text`` arguments stays lazy.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import isbn, text
from quillstone.operators import duplicates as D
from quillstone.operators import enrich as E
from quillstone.operators import search as S
from quillstone.sources import files
from quillstone.sources.sqltool import run_query

FIELDS = ("title", "authors", "publisher", "tags", "comments", "isbn")
_EMPTY = "id long, title string, authors array<string>, publisher string, tags array<string>, comments string, identifiers map<string,string>"


@dataclass(frozen=True)
class Library:
    """books: id, title, authors, publisher, tags, comments, identifiers; vectors: id, embedding; metadata: what an
    outside source knows, by ``isbn`` or ``title``."""

    books: DataFrame
    vectors: DataFrame | None = None
    metadata: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.books.sparkSession

    @property
    def numbered(self) -> DataFrame:
        """Books with ``isbn``: the stored one, else the first valid one in title or comments."""
        found = F.get(F.concat(isbn.extract(F.col("title")), isbn.extract(F.col("comments"))), F.lit(0))
        return self.books.withColumn("isbn", F.coalesce(F.try_element_at("identifiers", F.lit("isbn")), found))

    def list_books(self, term: str | None = None, sort_by: str = "title", limit: int | None = None) -> DataFrame:
        rows = self.books if not term else self.books.filter(F.col("title").ilike(f"%{term}%") | F.array_join("authors", " ").ilike(f"%{term}%"))
        rows = rows.orderBy(sort_by, "id")
        return rows if limit is None else rows.limit(limit)

    def search(self, query: str) -> DataFrame:
        """``field:value AND ...`` over id, title, author, publisher, tags and isbn."""
        rows = self.numbered
        fields = {"id": F.col("id"), "title": F.col("title"), "author": F.array_join("authors", " & "), "publisher": F.col("publisher"), "tags": F.array_join("tags", ","), "isbn": F.col("isbn")}
        return rows.filter(S.predicate(query, fields))

    def details(self, key: int, as_opf: bool = False) -> DataFrame:
        """One book's record, or (id, opf) with its metadata as XML."""
        rows = self.numbered.filter(F.col("id") == key)
        return rows.select("id", text.opf(F.col("title"), F.col("authors"), F.col("publisher"), F.col("isbn")).alias("opf")) if as_opf else rows

    def find_duplicates(self, least: float = 0.85) -> DataFrame:
        """(kind, name, ids): books alike in title and authors, books that share a number, and for each book those of the same authors with titles like its own."""
        same = D.exact_groups(self.books, ["title", "authors"]).select(F.col("key").alias("name"), "ids")
        values = self.books.select("id", F.explode("identifiers").alias("type", "value")).filter(F.lower("type").contains("isbn"))
        shared = values.groupBy(F.col("value").alias("name")).agg(F.array_sort(F.collect_set("id")).alias("ids")).filter("size(ids) > 1")
        similar = D.similar_groups(self.similar_titles(least)).select(F.col("group_id").alias("name"), "ids")
        return D.report(same, shared, similar)

    def _report(self, least: float) -> DataFrame:
        """The report's groups as Markdown in order of kind and name, a row a group."""
        order = F.array_position(F.array(*[F.lit(k) for k in ("exact", "isbn", "similar")]), F.col("kind"))
        return D.markdown(self.find_duplicates(least), self.books.select("id", "title")).orderBy(order, "name")

    def duplicate_report(self, least: float = 0.85) -> str:
        """The duplicates as Markdown, a section a kind. The text is as long as what was found; ``write_duplicate_report``
        writes what is too long to be shown."""
        out, kind = [], None
        for r in self._report(least).toLocalIterator():
            out += [f"## {r['kind']}"] * (r["kind"] != kind) + [r["text"]]
            kind = r["kind"]
        return "\n".join(out) or "No duplicates found"

    def write_duplicate_report(self, path: str, least: float = 0.85) -> None:
        """The duplicates as Markdown in files, a folder for each kind, a group after the other."""
        self._report(least).select("kind", "text").write.partitionBy("kind").text(path)

    def remove_duplicates(self, planned: DataFrame, mode: str, answers: DataFrame | None = None) -> tuple[Library, DataFrame, DataFrame]:
        """The library, the log and the summary of a run over a plan (group_id, id, action)."""
        left, log, summary = D.carry_out(self.books, planned, mode, answers)
        return replace(self, books=left), log, summary

    def similar_titles(self, least: float = 0.85) -> DataFrame:
        return D.similar_titles(self.books.withColumn("by", F.array_join(F.array_sort("authors"), ",")), ["by"], "title", least, ratio="sequence", both_ways=True, normal=True)

    def isbns_in(self, value: str) -> list[str]:
        return self.spark.range(1).select(isbn.extract(F.lit(value))).first()[0]

    def isbn_is_valid(self, value: str) -> bool:
        return self.spark.range(1).select(isbn.valid(F.lit(value))).first()[0]

    def books_with_isbn(self, value: str) -> DataFrame:
        return self.numbered.filter(isbn.bare(F.col("isbn")) == isbn.bare(F.lit(value)))

    def isbns_in_files(self, folder: str, pattern: str = "*.txt") -> DataFrame:
        return files.isbns_in_files(self.spark, folder, pattern)

    def fetch_metadata(self, title: str | None = None, number: str | None = None, authors: str | None = None, identifiers: Sequence[str] = ()) -> DataFrame:
        """What the outside source has; at least one thing to look for must be given. Identifiers are 'kind:value'."""
        if self.metadata is None or not (title or number or authors or identifiers):
            raise ValueError("give a title, authors, a number or identifiers to look for, and a source to look in")
        rows = self.metadata
        rows = rows.filter(isbn.bare(F.col("isbn")) == isbn.bare(F.lit(number))) if number else rows
        rows = rows.filter(F.lower("title") == title.lower()) if title else rows
        if authors:
            rows = rows.filter(F.lower(F.array_join("authors", " & ")).contains(authors.lower()))
        for kind, _, value in (x.partition(":") for x in identifiers):
            stored = isbn.bare(F.col("isbn")) if kind == "isbn" else F.try_element_at("identifiers", F.lit(kind)) if "identifiers" in rows.columns else F.lit(None).cast("string")
            rows = rows.filter(stored == F.lit(value))
        return rows

    def enrich(self, ids: DataFrame | None = None) -> DataFrame:
        """(id, identifier, success, error, found) of all books, or those of ``ids``: what the source says of the identifier
        that is chosen for each."""
        if self.metadata is None:
            raise ValueError("there is no source to look in")
        rows = self.books if ids is None else self.books.join(ids.select("id").distinct(), "id", "left_semi")
        of = lambda kind: F.try_element_at("identifiers", F.lit(kind))
        return E.found_by_identifier(rows.select("id", isbn.pick_for_batch(of("isbn"), of("amazon"), F.col("title")).alias("identifier")), self.metadata)

    def batch_enrich(self, fields: Sequence[str] = ("comments", "publisher", "tags"), limit: int = 10) -> DataFrame:
        """Looks up the first ``limit`` books, fifty at most, that have a number and lack any of the fields."""
        numbered = replace(self, books=self.books.filter(F.try_element_at("identifiers", F.lit("isbn")).isNotNull()))
        return self.enrich(numbered.needing_enrichment(fields, min(limit, 50)))

    def needing_enrichment(self, fields: Sequence[str] = FIELDS, limit: int = 50) -> DataFrame:
        """(id, title, missing): books that lack any of the fields; all their gaps are named."""
        lacks = {f: F.size(F.coalesce(f, F.array().cast("array<string>"))) == 0 if f in ("authors", "tags") else E.empty(F.col(f)) for f in FIELDS}
        rows = self.numbered.filter(E.any_of([lacks[f] for f in fields]))
        return rows.orderBy("id").limit(limit).select("id", "title", E.missing(lacks).alias("missing"))

    def suggestions(self, fields: Sequence[str] = ("title", "publisher", "comments")) -> DataFrame:
        """(id, field, current, suggested, reason) from the outside source, by number."""
        if self.metadata is None:
            raise ValueError("there is no source to look in")
        new = self.numbered.select("id", "isbn").join(self.metadata, "isbn").select("id", *[c for c in self.metadata.columns if c != "isbn"])
        return E.suggestions(self.books, new, "id", [f for f in fields if f in new.columns])

    def apply(self, wanted: Sequence[str] = ("all",), fields: Sequence[str] = ("title", "publisher", "comments")) -> Library:
        """The library with the suggested values of the wanted fields."""
        names = [f for f in fields if f in self.metadata.columns and (list(wanted) == ["all"] or f in wanted)]
        found = self.suggestions(names)
        return self.set_metadata(found.groupBy("id").agg(*[F.max(F.when(F.col("field") == f, F.col("suggested"))).alias(f) for f in names]))

    def indexed(self, c: Column | None = None) -> Library:
        """The library with vectors of its books by the stand-in encoder, of the given text or of all that is searchable."""
        parts = {"Title": F.col("title"), "Authors": F.array_join("authors", ", "), "Publisher": F.col("publisher"), "Tags": F.array_join("tags", ", "), "Description": text.strip_tags(F.col("comments"))}
        plain = text.labelled_parts(parts) if c is None else c
        return replace(self, vectors=S.encoded(self.books.withColumn("text", plain), "id", _words()))

    def cached_index(self, path: str, days: float = 7, now: float | None = None, force: bool = False) -> Library:
        """The library with the vectors at ``path``, built anew where they are missing, too old, or that is forced."""
        return replace(self, vectors=files.cached(self.spark, lambda: self.indexed().vectors, path, days, now, force))

    def search_text(self, query: DataFrame, n: int = 5) -> DataFrame:
        """The n books nearest a text, one row with ``text``, as semantic_search gives them."""
        vector = S.encoded(query.select(F.lit(0).alias("q"), "text"), "q", _words()).select("embedding")
        return self.semantic_search(vector, n)

    def semantic_search(self, query: DataFrame, n: int = 5) -> DataFrame:
        """Score, fields and preview of the n books nearest the query, one row with ``embedding``."""
        if self.vectors is None:
            raise ValueError("there are no vectors")
        hits = S.top_k(self.vectors, query, n, id_col="id")
        plain = text.preview(text.strip_tags(F.coalesce("comments", F.lit(""))))
        return S.hits(hits, self.numbered, plain)

    def add(self, rows: DataFrame) -> Library:
        return replace(self, books=self.books.unionByName(rows, allowMissingColumns=True))

    def remove(self, ids: Sequence[int]) -> Library:
        return replace(self, books=self.books.filter(~F.col("id").isin(*ids)))

    def set_metadata(self, changes: DataFrame) -> Library:
        """changes: id and the fields that get a new value where it isn't null."""
        return replace(self, books=E.patch(self.books, changes, "id"))

    def bulk_comments(self, ids: DataFrame, value: str) -> tuple[Library, DataFrame]:
        """The library with one comment on many books, and the outcome."""
        return self.set_metadata(ids.select("id").distinct().withColumn("comments", F.lit(value))), E.bulk_outcome(self.books, ids, "id")

    def add_isbn(self, key: int, value: str) -> Library:
        added = F.when(F.col("id") == key, E.add_identifier(F.col("identifiers"), "isbn", F.lit(value))).otherwise(F.col("identifiers"))
        return replace(self, books=self.books.withColumn("identifiers", added))


    def convert(self, key: int, kind: str) -> DataFrame:
        """(id, text) of one book's record in another form: 'opf', 'json' or 'txt'."""
        rows = self.numbered.filter(F.col("id") == key)
        forms = {"opf": text.opf(F.col("title"), F.col("authors"), F.col("publisher"), F.col("isbn")), "json": F.to_json(F.struct(*rows.columns)), "txt": text.labelled_parts({"Title": F.col("title"), "Authors": F.array_join("authors", ", "), "Description": text.strip_tags(F.col("comments"))}, "\n")}
        if kind.lower() not in forms:
            raise ValueError(f"can't convert to {kind!r}")
        return rows.select("id", forms[kind.lower()].alias("text"))

    def tools(self, sf_dir: str | None = None) -> Tools:
        return Tools(self, sf_dir)


def _words() -> Column:
    return F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"), lambda x: x != "")


class Tools:
    """The library's operations by name. ``call`` takes a name and named arguments, answers an unknown name with a message,
    and keeps the library that an operation which writes gives back."""

    def __init__(self, library: Library, sf_dir: str | None = None) -> None:
        self.library, self.sf_dir = library, sf_dir
        spark = library.spark
        ids = lambda values: spark.createDataFrame([(int(v),) for v in values], "id long")
        texts = lambda value: spark.createDataFrame([(value,)], "text string")
        self._calls = {
            "list_books": lambda lib, **a: lib.list_books(**a),
            "add_book": lambda lib, rows: lib.add(rows),
            "remove_book": lambda lib, book_id: lib.remove([book_id]),
            "set_book_metadata": lambda lib, changes: lib.set_metadata(changes),
            "convert_book": lambda lib, book_id, output_format: lib.convert(book_id, output_format),
            "search_library": lambda lib, query: lib.search(query),
            "bulk_update_comments": lambda lib, book_ids, comments: lib.bulk_comments(ids(book_ids), comments)[0],
            "get_book_details": lambda lib, book_id, as_opf=False: lib.details(book_id, as_opf),
            "find_duplicates": lambda lib, **a: lib.find_duplicates(**a),
            "isbn_extract_from_text": lambda lib, text: lib.isbns_in(text),
            "isbn_extract_from_file": lambda lib, folder, pattern="*.txt": lib.isbns_in_files(folder, pattern),
            "isbn_validate": lambda lib, isbn: lib.isbn_is_valid(isbn),
            "isbn_find_books": lambda lib, isbn: lib.books_with_isbn(isbn),
            "isbn_get_book_isbn": lambda lib, book_id: lib.details(book_id).select("id", "isbn"),
            "fetch_metadata_by_identifier": lambda lib, identifier_type, identifier_value: lib.fetch_metadata(identifiers=[f"{identifier_type}:{identifier_value}"]),
            "fetch_metadata_by_title": lambda lib, title, authors=None: lib.fetch_metadata(title=title, authors=authors),
            "enrich_book_metadata": lambda lib, book_id: lib.enrich(ids([book_id])),
            "apply_metadata_updates": lambda lib, updates=("all",): lib.apply(updates),
            "find_books_needing_enrichment": lambda lib, **a: lib.needing_enrichment(**a),
            "batch_enrich_books": lambda lib, limit=10: lib.batch_enrich(limit=limit),
            "semantic_search": lambda lib, query, top_n=5: (lib if lib.vectors is not None else lib.indexed()).search_text(texts(query), top_n),
            "sql": lambda lib, query: run_query(spark, self.sf_dir, query),
        }

    @property
    def names(self) -> list[str]:
        return sorted(self._calls)

    def call(self, name: str, arguments: Mapping) -> object:
        if name not in self._calls:
            return f"Unknown tool: {name}"
        result = self._calls[name](self.library, **arguments)
        if isinstance(result, Library):
            self.library = result
        return result

    def converse(self, next_call, most: int = 8) -> list[tuple[str, object]]:
        """Asks ``next_call(results so far)`` for a (name, arguments), or None to end, and calls it, ``most`` times at most."""
        done: list[tuple[str, object]] = []
        while len(done) < most and (asked := next_call(done)) is not None:
            done.append((asked[0], self.call(*asked)))
        return done


def of_rows(spark: SparkSession, rows: Sequence[Mapping]) -> Library:
    """A library of plain records; fields that are missing are null."""
    names = [c.split(" ")[0] for c in _EMPTY.replace("map<string,string>", "map").split(", ")]
    return Library(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], _EMPTY))

