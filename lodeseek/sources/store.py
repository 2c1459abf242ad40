"""An index in a folder: schema, manifest, immutable segments and tombstones.

    schema.json  manifest.json  .writer.lock
    segments/seg_000001/{postings,norms,stored}/*.parquet, segment.json
    tombstones/gen_000001/*.parquet

Postings stay in the partition their documents are in, sorted there by field, term and
document, so no posting is exchanged, a term's are split as the documents are, and a scan skips
what the statistics of files' row groups and pages rule out. All segments are read in one scan; a
row's segment comes from its file's path. Nothing is ever changed in place; the manifest,
put in place in one step, is the only root after a restart.
"""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AlreadyClosedError, CorruptIndexError, IndexAlreadyExistsError, IndexNotFoundError, SchemaError, SchemaMismatchError
from ..operators import inversion
from ..operators.snapshot import IndexSnapshot
from ..schema import Schema
from .files import Files

FORMAT = 2
SEGMENT = re.compile(r"seg_(\d{6,})")
#: Segments up to this size have their files' digests checked when they are opened; larger ones their lengths, and the digests on demand.
DIGEST_BYTES = 64 << 20
#: Larger files are digested in blocks on the driver, others whole where they are read.
WHOLE_BYTES = 256 << 20
#: So files stay well below WHOLE_BYTES.
FILE_ROWS = {"postings": 4_000_000, "norms": 10_000_000, "stored": 50_000}


def segment_dir(generation: int) -> str:
    return f"segments/seg_{generation:06d}"


def tombstone_dir(generation: int) -> str:
    return f"tombstones/gen_{generation:06d}"


def dumps(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


@dataclass(frozen=True)
class SegmentDescriptor:
    generation: int
    schema_fingerprint: str
    max_doc: int
    path: str


@dataclass(frozen=True)
class Manifest:
    """segments: generations in order. tombstones: a generation, or None. batch: the last micro-batch of a stream that is in."""

    schema_fingerprint: str
    commit_generation: int = 0
    segments: tuple[int, ...] = ()
    tombstones: int | None = None
    tombstone_files: Mapping[str, int] = field(default_factory=dict)
    tombstone_digests: Mapping[str, str] = field(default_factory=dict)
    next_segment: int = 1
    batch: int = -1
    format_version: int = FORMAT

    def __post_init__(self) -> None:
        if self.format_version != FORMAT:
            raise ValueError("unknown format of the manifest")
        if not self.schema_fingerprint or self.commit_generation < 0:
            raise ValueError("the manifest has no fingerprint or generation")
        if len(set(self.segments)) != len(self.segments) or self.next_segment <= max(self.segments, default=0):
            raise ValueError("the manifest's segments don't fit together")

    @property
    def segment_generations(self) -> tuple[int, ...]:
        return self.segments

    @classmethod
    def from_json(cls, value: object) -> Manifest:
        if not isinstance(value, dict) or set(value) != set(cls.__dataclass_fields__):
            raise ValueError("the manifest doesn't have its keys")
        return cls(**value | {"segments": tuple(value["segments"])})


@dataclass(frozen=True)
class LifecycleDiagnostics:
    reader_owners: tuple[str, ...]
    writer_owner: str | None
    segment_owners: Mapping[int, tuple[str, ...]]


class Registry:
    """Who in this process uses which segments, so that garbage collection leaves them."""

    _all: dict[str, Registry] = {}
    _lock = threading.RLock()

    def __init__(self):
        self.owners: dict[str, tuple[str, frozenset[int]]] = {}

    @classmethod
    def of(cls, root: str) -> Registry:
        with cls._lock:
            return cls._all.setdefault(root, cls())

    def acquire(self, kind: str, generations) -> str:
        owner = f"{kind}-{uuid.uuid4().hex}"
        with self._lock:
            self.owners[owner] = (kind, frozenset(generations))
        return owner

    def change(self, owner: str, generations) -> None:
        with self._lock:
            self.owners[owner] = (self.owners[owner][0], frozenset(generations))

    def release(self, owner: str) -> None:
        with self._lock:
            self.owners.pop(owner, None)

    def used(self) -> set[int]:
        with self._lock:
            return {g for _, gs in self.owners.values() for g in gs}

    def diagnostics(self) -> LifecycleDiagnostics:
        with self._lock:
            of = lambda kind: sorted(o for o, (k, _) in self.owners.items() if k == kind)
            return LifecycleDiagnostics(tuple(of("reader")), next(iter(of("writer")), None), {g: tuple(sorted(o for o, (_, gs) in self.owners.items() if g in gs)) for g in sorted(self.used())})


def digests(files: Files, name: str) -> dict[str, str]:
    """SHA-256 of the Parquet files below name, by path relative to it: of small ones where they are read, of large ones in blocks."""
    sizes = {k: n for k, n in files.sizes(name).items() if k.endswith(".parquet")}
    small = [k for k, n in sizes.items() if n <= WHOLE_BYTES]
    out = {k: files.digest(f"{name}/{k}") for k in sizes.keys() - set(small)}
    if small:
        whole = files.spark.read.format("binaryFile").load([files.at(f"{name}/{k}") for k in small])
        base = f"/{name}/"
        out |= {r[0][r[0].index(base) + len(base) :]: r[1] for r in whole.select("path", F.sha2("content", 256)).collect()}
    return out


class Segments:
    """Publishes and opens segments."""

    def __init__(self, spark: SparkSession, files: Files, schema: Schema):
        self.spark, self.files, self.schema = spark, files, schema

    def free(self, generation: int) -> int:
        """The first generation from here on without a folder, complete or not."""
        while self.files.exists(segment_dir(generation)):
            generation += 1
        return generation

    def publish(self, generation: int, tables: Mapping[str, DataFrame]) -> SegmentDescriptor:
        """tables: stored, and postings and norms or inverted, which is both and is written in one pass.

        Writes beside, describes, renames; a failure leaves nothing under the segment's name.
        """
        if self.files.exists(segment_dir(generation)):
            raise FileExistsError(segment_dir(generation))
        tmp = f"segments/.tmp-{uuid.uuid4().hex}"
        try:
            for name, df in tables.items():
                w = df.drop("segment")
                if name == "inverted":
                    self._publish_inverted(w, tmp)
                    continue
                if name == "postings":
                    w = w.sortWithinPartitions("field", "term", "doc_id")
                w.write.option("maxRecordsPerFile", FILE_ROWS[name]).parquet(self.files.at(f"{tmp}/{name}"))
            sizes = {k: v for k, v in self.files.sizes(tmp).items() if k.endswith(".parquet")}
            about = {"format_version": FORMAT, "generation": generation, "schema_fingerprint": self.schema.fingerprint, "max_doc": self.spark.read.parquet(self.files.at(f"{tmp}/stored")).count(), "files": sizes, "digests": digests(self.files, tmp)}
            self.files.create(f"{tmp}/segment.json", dumps(about))
            self.files.rename(tmp, segment_dir(generation))
        except BaseException:
            self.files.remove(tmp)
            raise
        return SegmentDescriptor(generation, self.schema.fingerprint, about["max_doc"], self.files.at(segment_dir(generation)))

    def _publish_inverted(self, made: DataFrame, tmp: str) -> None:
        norm = F.col("term").isNull()
        both = made.withColumn("length", F.when(norm, F.col("dl"))).withColumn("_table", F.when(norm, "norms").otherwise("postings"))
        both.sortWithinPartitions("_table", "field", "term", "doc_id").write.partitionBy("_table").option("maxRecordsPerFile", FILE_ROWS["postings"]).parquet(self.files.at(f"{tmp}/inverted"))
        for name in ("postings", "norms"):
            if self.files.exists(f"{tmp}/inverted/_table={name}"):
                self.files.rename(f"{tmp}/inverted/_table={name}", f"{tmp}/{name}")
            else:  # no document has a term
                made.withColumn("length", F.col("dl")).limit(0).write.parquet(self.files.at(f"{tmp}/{name}"))
        self.files.remove(f"{tmp}/inverted")

    def describe(self, generation: int, deep: bool | None = None) -> dict:
        """segment.json, after the files it names have been checked."""
        where = segment_dir(generation)
        try:
            about = self.files.read_json(f"{where}/segment.json")
            known = about["format_version"] == FORMAT and about["generation"] == generation and isinstance(about["max_doc"], int)
        except (OSError, ValueError, KeyError, TypeError) as e:
            raise CorruptIndexError(f"segment {generation} can't be read: {e}") from e
        if not known or about["schema_fingerprint"] != self.schema.fingerprint:
            raise CorruptIndexError(f"segment {generation} is of another index")
        sizes = {k: v for k, v in self.files.sizes(where).items() if k.endswith(".parquet")}
        if sizes != about["files"]:
            raise CorruptIndexError(f"segment {generation} doesn't have its files")
        if (sum(sizes.values()) <= DIGEST_BYTES if deep is None else deep) and digests(self.files, where) != about["digests"]:
            raise CorruptIndexError(f"a file of segment {generation} has been changed")
        return about

    def open(self, generation: int) -> dict[str, DataFrame]:
        return self.all([generation])

    def all(self, generations) -> dict[str, DataFrame]:
        """Tables of several segments, each in one scan however many there are."""
        if not generations:
            empty = inversion.with_all_fields(self.spark.createDataFrame([], "segment int, doc_id long"), self.schema)
            return {"postings": inversion.postings(empty, self.schema), "norms": inversion.norms(empty, self.schema), "stored": inversion.stored(empty, self.schema)}

        def read(name: str, schema: str, *columns: str) -> DataFrame:
            df = self.spark.read.schema(schema).parquet(*[self.files.at(f"{segment_dir(g)}/{name}") for g in generations])
            segment = F.lit(generations[0]) if len(generations) == 1 else F.substring(F.substring_index(F.substring_index("_metadata.file_path", "/", -3), "/", 1), 5, 20).cast("int")  # seg_…/name/file
            return df.select(segment.alias("segment"), *columns)

        stored = ["doc_id", *(f"`f_{n}`" for n in self.schema.stored)]
        return {
            "postings": read("postings", "field string, term string, doc_id long, tf int, positions array<int>, dl int", "field", "term", "doc_id", "tf", "positions", "dl"),
            "norms": read("norms", "field string, doc_id long, length int", "field", "doc_id", "length"),
            "stored": read("stored", ", ".join([f"{c} {'long' if c == 'doc_id' else 'string'}" for c in stored]), *stored),
        }

    def verify(self, generation: int) -> None:
        """All digests, and the tables' invariants by aggregates over them."""
        about = self.describe(generation, deep=True)
        wrong = inversion.validate(self.open(generation), about["max_doc"])
        if wrong:
            raise CorruptIndexError(f"segment {generation} has {', '.join(wrong)}")

    def tombstones(self, generation: int | None, sizes: Mapping[str, int] | None = None, told: Mapping[str, str] | None = None, deep: bool | None = None) -> DataFrame | None:
        if generation is None:
            return None
        where = tombstone_dir(generation)
        if sizes is not None and {k: v for k, v in self.files.sizes(where).items() if k.endswith(".parquet")} != dict(sizes):
            raise CorruptIndexError(f"tombstones {generation} don't have their files")
        if told is not None and (sum((sizes or {}).values()) <= DIGEST_BYTES if deep is None else deep) and digests(self.files, where) != dict(told):
            raise CorruptIndexError(f"a file of tombstones {generation} has been changed")
        return self.spark.read.schema("segment int, doc_id long").parquet(self.files.at(where))


class Index:
    """A folder with an index."""

    def __init__(self, spark: SparkSession, path: str, schema: Schema):
        self.spark, self.files, self.schema = spark, Files(spark, str(path)), schema
        self.path, self.registry, self._closed = str(path), Registry.of(self.files.root), False
        self.segments = Segments(spark, self.files, schema)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: Schema) -> Index:
        files = Files(spark, str(path))
        if files.names():
            raise IndexAlreadyExistsError(f"not empty: {path}")
        files.mkdirs("")
        files.replace("schema.json", dumps({"format_version": FORMAT, "fields": schema.to_dict(), "fingerprint": schema.fingerprint}))
        files.replace("manifest.json", dumps(asdict(Manifest(schema.fingerprint))))
        return cls(spark, path, schema)

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: Schema | None = None) -> Index:
        files = Files(spark, str(path))
        if not files.exists("manifest.json"):
            raise IndexNotFoundError(f"no manifest: {path}")
        try:
            told = files.read_json("schema.json")
            kept = Schema.from_dict(told["fields"])
            fits = told["format_version"] == FORMAT and told["fingerprint"] == kept.fingerprint
        except (OSError, ValueError, KeyError, TypeError, AttributeError, SchemaError) as e:
            raise SchemaMismatchError(f"the schema can't be read: {e}") from e
        index = cls(spark, path, kept)
        if not fits or index.manifest().schema_fingerprint != kept.fingerprint or (schema is not None and schema.fingerprint != kept.fingerprint):
            raise SchemaMismatchError("the schema's fingerprints differ")
        return index

    def _open(self) -> None:
        if self._closed:
            raise AlreadyClosedError("this index is closed")

    def manifest(self) -> Manifest:
        self._open()
        return Manifest.from_json(self.files.read_json("manifest.json"))

    def publish(self, manifest: Manifest) -> Manifest:
        self.files.replace("manifest.json", dumps(asdict(manifest)))
        return manifest

    def open_reader(self) -> IndexSnapshot:
        """Lengths of all files are checked, and the digests of segments and tombstones of up to DIGEST_BYTES; verify() checks all."""
        m = self.manifest()
        for g in m.segments:
            self.segments.describe(g)
        return self.reader(m.segments, self.segments.tombstones(m.tombstones, m.tombstone_files, m.tombstone_digests), m.commit_generation)

    def reader(self, generations, deleted: DataFrame | None, commit_generation: int | None) -> IndexSnapshot:
        owner = self.registry.acquire("reader", generations)
        return IndexSnapshot(self.schema, self.segments.all(generations), deleted, commit_generation, lambda: self.registry.release(owner))

    def writer(self, **options):
        self._open()
        from .writer import IndexWriter

        return IndexWriter(self, **options)

    def verify(self) -> None:
        """Reads every committed segment whole; CorruptIndexError if something doesn't fit."""
        m = self.manifest()
        for g in m.segments:
            self.segments.verify(g)
        self.segments.tombstones(m.tombstones, m.tombstone_files, m.tombstone_digests, deep=True)

    def collect_garbage(self) -> tuple[str, ...]:
        """Removes complete segments that neither the manifest nor anyone in this process uses."""
        self._open()
        keep = set(self.manifest().segments) | self.registry.used()
        gone = []
        for name in self.files.names("segments"):
            m = SEGMENT.fullmatch(name)
            if m and int(m[1]) not in keep and self.files.exists(f"segments/{name}/segment.json"):
                self.files.remove(f"segments/{name}")
                gone.append(self.files.at(f"segments/{name}"))
        return tuple(gone)

    def lifecycle_diagnostics(self) -> LifecycleDiagnostics:
        return self.registry.diagnostics()

    def close(self) -> LifecycleDiagnostics:
        self._closed = True
        return self.registry.diagnostics()

    def __enter__(self) -> Index:
        self._open()
        return self

    def __exit__(self, *_) -> None:
        self.close()
