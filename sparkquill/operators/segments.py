"""Tables and a keyword index that grow by immutable segments: adding and removing write what changes, not the whole.

Rows added together are a segment; of documents, their postings, sorted by term, and their lengths. Removing writes a list of ids.
Both carry a number that grows; a list holds for the segments before it, so an id may come back later. The manifest names
segments and lists with their signed counts of documents and tokens, so the corpus statistics are sums of its entries.

Segments of about one size are merged once there are `FAN` of them: removed documents are left out, and so are lists that
no older segment needs. A posting is thus rewritten a logarithmic number of times.

A manifest is a file made whole in one step and never replaced, its number one above the last, so of two writers one
wins and the other is told. Whoever stops in between leaves files that no manifest names. A reader holds the manifest it
has opened: files go only when the last `keep` manifests no longer name them."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable
from copy import copy
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkquill.files import Files
from sparkquill.operators import bm25
from sparkquill.tables import scratch, written

#: Segments of one size that are merged, and postings of the smallest size.
FAN, SMALLEST = 4, 10_000
#: Postings that a task sorts and a file of a segment holds, some 100 bytes each in memory.
SORTED = 2_000_000
#: Share of a segment's documents that are removed from which on it is written anew by the next merge.
DEAD = 0.5
_POSTINGS = "term string, doc_id long, tf long, dl long, lead boolean"
_DOCS = "doc_id long, dl long"


class Conflict(RuntimeError):
    """Another writer has made the manifest first; open the index again."""


@dataclass(frozen=True)
class Part:
    """A segment (postings > 0) or a list of removed ids: its documents and their tokens, and its number."""

    name: str
    seq: int
    docs: int
    tokens: int
    postings: int = 0
    #: Of a segment, documents that later lists have removed.
    gone: int = 0

    @property
    def size(self) -> int:
        return int(math.log(max(self.postings, 1) / SMALLEST, FAN)) if self.postings > SMALLEST else 0


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    segments: list[Part] = field(default_factory=list)
    removals: list[Part] = field(default_factory=list)

    @property
    def docs(self) -> int:
        return sum(s.docs for s in self.segments) - sum(r.docs for r in self.removals)

    @property
    def tokens(self) -> int:
        return sum(s.tokens for s in self.segments) - sum(r.tokens for r in self.removals)

    def next_seq(self) -> int:
        return 1 + max([p.seq for p in (*self.segments, *self.removals)], default=0)


def _union(parts: Iterable[DataFrame], empty: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts, empty)


class Parts:
    """Rows by key below `root` as the manifest of its opening has them. Changing them returns the new state."""

    #: The key's column, the folder and the schema of the rows.
    key, main, schema = "id", "rows", "id long"
    #: Folders whose parts bear the names of segments.
    folders = ("rows",)

    def __init__(self, spark: SparkSession, root: str, manifest: Manifest | None = None):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self.manifest = manifest or self._last()

    def _numbers(self) -> list[int]:
        names = self.files.names(f"{self.root}/manifests")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def _last(self) -> Manifest:
        numbers = self._numbers()
        return self._read(numbers[-1]) if numbers else Manifest()

    def _read(self, number: int) -> Manifest:
        found = json.loads(self.files.text(f"{self.root}/manifests/{number}.json"))
        return Manifest(found["number"], [Part(**s) for s in found["segments"]], [Part(**r) for r in found["removals"]])

    def _commit(self, segments: list[Part], removals: list[Part]):
        made = Manifest(self.manifest.number + 1, segments, removals)
        if not self.files.put_once(f"{self.root}/manifests/{made.number}.json", json.dumps(asdict(made))):
            raise Conflict(f"manifest {made.number} of {self.root} exists")
        out = copy(self)
        out.manifest = made
        return out

    def _table(self, kind: str, part: Part, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{kind}/{part.name}")

    def _removed(self) -> DataFrame | None:
        """The key and the number of the last list that names it."""
        if not self.manifest.removals:
            return None
        each = [self._table("removals", r, f"{self.key} long").withColumn("__until", F.lit(r.seq)) for r in self.manifest.removals]
        return reduce(DataFrame.unionByName, each).groupBy(self.key).agg(F.max("__until").alias("__until"))

    def _live(self, kind: str, schema: str, segments: list[Part], wanted: DataFrame | None = None) -> DataFrame:
        empty = self.spark.createDataFrame([], f"{schema}, __seq int")
        rows = _union((self._table(kind, s, schema).withColumn("__seq", F.lit(s.seq)) for s in segments), empty)
        if wanted is not None:
            rows = rows.join(wanted, "term", "left_semi")
        removed = self._removed()
        if removed is not None:
            # Only rows from before the list are gone.
            rows = rows.join(removed, self.key, "left").filter(F.col("__until").isNull() | (F.col("__until") < F.col("__seq"))).drop("__until")
        return rows

    def _keys(self) -> DataFrame:
        """The key, dl (what a row counts for) and __seq of what is there."""
        return self._live(self.main, self.schema, self.manifest.segments).select(self.key, F.lit(0).cast("long").alias("dl"), "__seq")

    def _segment(self, rows: DataFrame, seq: int) -> Part:
        raise NotImplementedError

    def _list(self, ids: DataFrame) -> tuple[Part | None, list[Part]]:
        """A list of those of `ids` that are present, None if there are none, and the segments with what they lose."""
        name = uuid.uuid4().hex
        wanted = ids.select(F.col(self.key).cast("long").alias(self.key)).distinct()
        self._keys().join(wanted, self.key).write.parquet(f"{self.root}/removals/{name}")
        gone = self.spark.read.schema(f"{self.key} long, dl long, __seq int").parquet(f"{self.root}/removals/{name}")
        each = {r["__seq"]: (r["n"], r["dl"]) for r in gone.groupBy("__seq").agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).collect()}
        if not each:
            return None, self.manifest.segments
        made = Part(name, self.manifest.next_seq(), sum(n for n, _ in each.values()), sum(t for _, t in each.values()))
        return made, [replace(s, gone=s.gone + each.get(s.seq, (0, 0))[0]) for s in self.manifest.segments]

    def remove(self, ids: DataFrame):
        """Without the rows of `ids` (the key's column), as a list; ids that aren't present don't count."""
        made, segments = self._list(ids)
        return self if made is None else self._commit(segments, [*self.manifest.removals, made])._merged()

    def _due(self) -> list[Part]:
        """Segments to merge: `FAN` of the least size that has so many, or those that are mostly removed."""
        by_size: dict[int, list[Part]] = {}
        for s in self.manifest.segments:
            by_size.setdefault(s.size, []).append(s)
        for size in sorted(by_size):
            if len(by_size[size]) >= FAN:
                return by_size[size]
        return [s for s in self.manifest.segments if s.gone > DEAD * s.docs]

    def _merged(self):
        """Merges until nothing is due."""
        now = self
        while due := now._due():
            now = now.merge(due)
        return now

    def merge(self, due: list[Part] | None = None):
        """Segments, all by default, as one. It takes the next number, so no list that there is holds for it."""
        due = self.manifest.segments if due is None else due
        rest = [s for s in self.manifest.segments if s not in due]
        made = self._segment(self._live(self.main, self.schema, due).drop("__seq"), self.manifest.next_seq())
        # Removed rows of the merged segments are gone for good: each list gives back what it took of them.
        removals = []
        for r in self.manifest.removals:
            taken = self._table("removals", r, f"{self.key} long, dl long, __seq int").filter(F.col("__seq").isin([s.seq for s in due]))
            n, tokens = taken.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            if r.docs > n:
                removals.append(replace(r, docs=r.docs - n, tokens=r.tokens - tokens))
        return self._commit([*rest, *([made] if made.docs else [])], removals)

    def expire(self, keep: int = 2) -> None:
        """Deletes manifests but the last `keep`, and files that none of those names. Only the one writer may call it."""
        numbers = self._numbers()
        kept = [self._read(n) for n in numbers[-keep:]]
        for n in numbers[:-keep]:
            self.files.delete(f"{self.root}/manifests/{n}.json")
        segments = {s.name for m in kept for s in m.segments}
        removals = {r.name for m in kept for r in m.removals}
        for kind, names in (*((f, segments) for f in self.folders), ("removals", removals)):
            for name in self.files.names(f"{self.root}/{kind}"):
                if name not in names:
                    self.files.delete(f"{self.root}/{kind}/{name}")


class KeyedTable(Parts):
    """A table of unique long keys whose changes are written as what changes and merged when it is read."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str):
        self.key, self.kind = key, schema
        self.schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        super().__init__(spark, root)

    def read(self) -> DataFrame:
        return self._live("rows", self.schema, self.manifest.segments).select(self.kind.names)

    def _segment(self, rows: DataFrame, seq: int) -> Part:
        name = uuid.uuid4().hex
        rows.select(self.kind.names).write.parquet(f"{self.root}/rows/{name}")
        n = self.spark.read.schema(self.schema).parquet(f"{self.root}/rows/{name}").count()
        return Part(name, seq, n, 0, n)

    def add(self, rows: DataFrame) -> KeyedTable:
        """With more rows, whose keys aren't present."""
        made = self._segment(rows, self.manifest.next_seq())
        return self._commit([*self.manifest.segments, made], self.manifest.removals)._merged() if made.docs else self

    def upsert(self, rows: DataFrame) -> KeyedTable:
        """With rows in place of those of the same keys, in one step: a list and a segment of one manifest."""
        rows = written(rows.select(self.kind.names), "upsert")
        gone, segments = self._list(rows)
        if gone is None:
            return self.add(rows)
        made = self._segment(rows, gone.seq + 1)
        return self._commit([*segments, made], [*self.manifest.removals, gone])._merged()


class SegmentIndex(Parts):
    """A keyword index: postings, sorted by term, and the lengths of their documents."""

    key, main, schema, folders = "doc_id", "postings", _POSTINGS, ("postings", "lengths")

    def _keys(self) -> DataFrame:
        return self._live("lengths", _DOCS, self.manifest.segments)

    def documents(self) -> DataFrame:
        """doc_id, dl of what is in the index."""
        return self._live("lengths", _DOCS, self.manifest.segments).drop("__seq")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """The live postings, of certain terms or all; terms reach the files' scan as a join on the sorted column."""
        return self._live("postings", _POSTINGS, self.manifest.segments, terms).drop("__seq")

    def stats(self) -> DataFrame:
        n, total = self.manifest.docs, self.manifest.tokens
        return self.spark.createDataFrame([(n, total, total / n if n else None)], "n long, total long, avgdl double")

    def index(self, terms: DataFrame | None = None) -> bm25.Index:
        return bm25.Index(self.postings(terms), self.stats())

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """qid, doc_id, score, rank, as from an index built of all live documents at once."""
        terms = bm25.query_terms(queries)
        some = self.postings(terms.select("term").distinct())
        return bm25.ranked(bm25.scored(some, self.stats(), terms), k)

    def _segment(self, postings: DataFrame, seq: int) -> Part:
        """Writes postings, sorted by term over files of about even size, and the lengths of their documents."""
        name = uuid.uuid4().hex
        # Ranges are cut after a look at all rows, which are therefore made once before; a task sorts a bounded number.
        with scratch([]):
            postings = written(postings, "postings")
            n = postings.count()
            postings.repartitionByRange(max(1, -(-n // SORTED)), "term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{self.root}/postings/{name}")
        kept = self.spark.read.schema(_POSTINGS).parquet(f"{self.root}/postings/{name}")
        kept.filter("lead").select("doc_id", "dl").write.parquet(f"{self.root}/lengths/{name}")
        sums = self.spark.read.schema(_DOCS).parquet(f"{self.root}/lengths/{name}").agg(F.count("*"), F.sum("dl")).first()
        return Part(name, seq, sums[0], sums[1] or 0, n)

    def add(self, docs: DataFrame, ident: str = "doc_id", text: str = "text") -> SegmentIndex:
        """With more documents, as a segment; ids that are present and documents without a token are left out. Of repeats
        of an id within `docs` one stays."""
        rows = docs.filter(F.col(ident).isNotNull()).dropDuplicates([ident])
        new = bm25.tokenized(rows, ident, text).join(self.documents().select("doc_id"), "doc_id", "left_anti")
        made = self._segment(bm25.posted(new), self.manifest.next_seq())
        if not made.docs:
            return self
        return self._commit([*self.manifest.segments, made], self.manifest.removals)._merged()

    def reconcile(self, docs: DataFrame, ident: str = "doc_id", text: str = "text") -> SegmentIndex:
        """The index of exactly these documents, by what differs: a call that was stopped anywhere is made good by the next."""
        wanted = docs.select(F.col(ident).cast("long").alias("doc_id"))
        known = self.documents().select("doc_id")
        gone = known.join(wanted, "doc_id", "left_anti")
        now = self.remove(gone) if not gone.isEmpty() else self
        return now.add(docs, ident, text)
