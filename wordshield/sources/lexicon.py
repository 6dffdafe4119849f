"""The word list: readers, keyed changes, paging, persistence. Each change gives a new, immutable Lexicon."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as tx
from ..functions.chars import SPACE
from ..operators.order import counted, line_numbers
from ..schemas import LEXICON

# The words that a new list starts with, in order.
DEFAULT_WORDS = [
    "anal", "ass", "bastard", "bitch", "damn", "fuck", "shit", "cunt", "dick", "piss", "slut", "whore",
    "kill", "murder", "terrorist", "bomb",
    "cocaine", "heroin", "marijuana", "meth", "opium",
    "nazi", "racist",
    "bully", "harass",
]


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def key(word: Column) -> Column:
    return F.lower(trimmed(word))


def _entries(rows: DataFrame) -> DataFrame:
    """rows (word, base_score, tags, enabled, ord) as new entries; words that are blank go."""
    now = F.current_timestamp()
    full = rows.withColumns({"normalized": tx.normalize(F.col("word")), "id": F.lit(None).cast("long"), "created_at": now, "updated_at": now})
    return full.where(key(F.col("word")) != "").select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in LEXICON))


def read_txt(spark: SparkSession, path: str, score: float = 0.5) -> DataFrame:
    """One word a line; blank lines and # comments are skipped."""
    lines = line_numbers(spark.read.text(path).select(trimmed(F.col("value")).alias("word")), "ord")
    lines = lines.where((F.col("word") != "") & ~F.col("word").startswith("#"))
    return _entries(lines.withColumns({"base_score": F.lit(score), "tags": F.array().cast("array<string>"), "enabled": F.lit(True)}))


def split_tags(tags: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def read_csv(spark: SparkSession, path: str, default_score: float = 0.5) -> DataFrame:
    """Header word,base_score,tags (the last two may be missing); rows whose score isn't a number are left out."""
    raw = spark.read.csv(path, header=True)
    score = F.col("base_score") if "base_score" in raw.columns else F.lit(None).cast("string")
    tags = F.col("tags") if "tags" in raw.columns else F.lit(None).cast("string")
    rows = raw.select(F.trim(F.coalesce("word", F.lit(""))).alias("word"), score.alias("score"), split_tags(tags).alias("tags"))
    rows = line_numbers(rows, "ord").withColumn("base_score", F.coalesce(F.expr("try_cast(score as double)"), F.when(F.coalesce(F.trim("score"), F.lit("")) == "", F.lit(default_score)))).where("base_score is not null")
    return _entries(rows.withColumn("enabled", F.lit(True)))


def read_json(spark: SparkSession, path: str, default_score: float = 0.5) -> DataFrame:
    """An array of objects, or one object; missing fields get defaults, ids and times are kept where they are given."""
    rows = spark.read.schema("word string, base_score double, tags array<string>, enabled boolean, id bigint, created_at timestamp, updated_at timestamp").option("multiLine", True).json(path)
    return _filled(line_numbers(rows, "ord"), default_score)


def _filled(rows: DataFrame, default_score: float = 0.5) -> DataFrame:
    defaults = {"word": F.lit(""), "base_score": F.lit(default_score), "tags": F.array().cast("array<string>"), "enabled": F.lit(True), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp()}
    filled = rows.withColumns({k: F.coalesce(k, v) for k, v in defaults.items()}).withColumn("normalized", tx.normalize(F.col("word")))
    return filled.where(key(F.col("word")) != "").select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in LEXICON))


def _snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A saved list, as JSON lines or as one array; missing fields get defaults, of equal keys the last row counts, and rows without an id get new ones.

    Rows without an ord, which another program wrote, follow each other as they lie in the file.
    """
    reader = spark.read.schema(LEXICON).option("multiLine", path.endswith(".json"))
    rows = line_numbers(reader.json(path), "line")
    return upserted(spark.createDataFrame([], LEXICON), _filled(rows.withColumn("ord", F.coalesce("ord", "line"))))


READERS = {"json": read_json, "csv": read_csv}


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """JSON and CSV by extension, any other file as one word a line."""
    return READERS.get(path.rpartition(".")[2].lower(), read_txt)(spark, path)


def from_rows(spark: SparkSession, rows: list[dict], max_words: int = 100_000, max_word_length: int = 256) -> DataFrame:
    """Checked rows: word of 1 to max_word_length characters, base_score within 0 and 1."""
    return _entries(_table(spark, _checked(rows, max_words, max_word_length)))


def _checked(rows: list[dict], max_words: int, max_word_length: int) -> list[dict]:
    if len(rows) > max_words:
        raise ValueError(f"more than {max_words} words")
    for r in rows:
        if not 1 <= len(r["word"]) <= max_word_length or not 0 <= r.get("base_score", 0.5) <= 1:
            raise ValueError(f"not a valid entry: {r}")
    return [{"word": r["word"], "base_score": float(r.get("base_score", 0.5)), "tags": list(r.get("tags", [])), "enabled": bool(r.get("enabled", True)), "ord": k} for k, r in enumerate(rows)]


_TYPES = {"word": pa.string(), "normalized": pa.string(), "base_score": pa.float64(), "tags": pa.list_(pa.string()), "enabled": pa.bool_(), "id": pa.int64(), "ord": pa.int64(), "created_at": pa.timestamp("us", "UTC"), "updated_at": pa.timestamp("us", "UTC")}


def _table(spark: SparkSession, rows: list[dict], names: tuple[str, ...] = ("word", "base_score", "tags", "enabled", "ord")) -> DataFrame:
    return spark.createDataFrame(pa.table({k: pa.array([r[k] for r in rows], _TYPES[k]) for k in names}))


#: Rows of one batch that are numbered together.
PIECE = 10_000


def upserted(old: DataFrame, new: DataFrame, following: DataFrame | None = None) -> DataFrame:
    """old with new's rows added in order: a known key keeps word, normalized, id, ord and creation time and takes the rest of its last row.

    New keys get an ord, and where they bring none an id, from following (next_id, next_ord; one row) on. Rows meet by key,
    and the new ones are counted in pieces by their ord, which should rise by small steps.
    """
    first = F.struct(F.col("batch"), F.col("ord"))
    both = old.withColumn("batch", F.lit(0)).unionByName(new.withColumn("batch", F.lit(1))).withColumn("key", key(F.col("word")))
    kept = [F.min_by(c, first).alias(c) for c in ("word", "normalized", "id", "created_at")]
    last = [F.max_by(c, first).alias(c) for c in ("base_score", "tags", "enabled", "updated_at")]
    merged = both.groupBy("key").agg(*kept, *last, F.min(first).alias("at")).select("*", "at.batch", "at.ord")
    fresh, unnamed = F.col("batch") == 1, (F.col("batch") == 1) & F.col("id").isNull()
    piece = F.shiftleft(F.col("batch").cast("long"), 50) + F.floor(F.col("ord") / PIECE)
    ranked = counted(merged, piece, ["batch", "ord"], {"nth": fresh, "nth_unnamed": unnamed})
    following = counters(new) if following is None else following.crossJoin(counters(new).select(F.col("next_id").alias("given"))).select(F.greatest("next_id", "given").alias("next_id"), "next_ord")
    out = ranked.crossJoin(F.broadcast(following))
    out = out.withColumns({"id": F.when(unnamed, F.col("next_id") + F.col("nth_unnamed") - 1).otherwise(F.col("id")), "ord": F.when(fresh, F.col("next_ord") + F.col("nth") - 1).otherwise(F.col("ord"))})
    return out.select(*(F.col(f.name) for f in LEXICON))


def counters(entries: DataFrame) -> DataFrame:
    """One row (next_id, next_ord) of entries; for rows that aren't entries yet, what follows the ids that they bring."""
    return entries.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"), F.lit(1).cast("long").alias("next_ord"))


def _saved_counters(spark: SparkSession, path: str) -> DataFrame | None:
    """What save() has written beside the list; None for a list of another program."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.next")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema("next_id long, next_ord long").json(f"{path}.next")


@dataclass(frozen=True)
class Lexicon:
    """entries has the schema LEXICON. used, if given, is one row (next_id, next_ord): what no entry had so far, deleted ones included, so that ids are never given again."""

    entries: DataFrame
    used: DataFrame | None = None

    def following(self) -> DataFrame:
        """One row (next_id, next_ord) for the next entry."""
        found = self.entries.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"), (F.coalesce(F.max("ord"), F.lit(0)) + 1).alias("ord"))
        if self.used is None:
            return found.select(F.col("id").alias("next_id"), F.col("ord").alias("next_ord"))
        return found.crossJoin(F.broadcast(self.used)).select(F.greatest("id", "next_id").alias("next_id"), F.greatest("ord", "next_ord").alias("next_ord"))

    def _with(self, entries: DataFrame) -> Lexicon:
        return Lexicon(entries, self.following())

    @staticmethod
    def of(spark: SparkSession, words: list[str] | list[dict], score: float = 0.5, config: Config | None = None) -> Lexicon:
        """A list of words that the driver holds, within the configuration's limits; made in place, as from_rows() and add_many() would."""
        config = config or Config()
        found: dict[str, dict] = {}
        for r in _checked([w if isinstance(w, dict) else {"word": w, "base_score": score} for w in words], config.max_words, config.max_word_length):
            name = r["word"].strip().lower()
            if name:
                found[name] = {**r, "word": found[name]["word"]} if name in found else r
        now = datetime.now(timezone.utc)
        rows = [{**r, "normalized": unicodedata.normalize("NFKC", r["word"]).lower(), "id": k + 1, "ord": k + 1, "created_at": now, "updated_at": now} for k, r in enumerate(found.values())]
        return Lexicon(_table(spark, rows, tuple(f.name for f in LEXICON)))

    @staticmethod
    def empty(spark: SparkSession) -> Lexicon:
        return Lexicon(spark.createDataFrame([], LEXICON))

    @staticmethod
    def load(spark: SparkSession, path: str | None = None, fill: bool = True) -> Lexicon:
        """The list persisted at path; fill adds those default words that it lacks."""
        found = Lexicon(_snapshot(spark, path), _saved_counters(spark, path)) if path else Lexicon.empty(spark)
        if not fill:
            return found
        missing = from_rows(spark, [{"word": w} for w in DEFAULT_WORDS]).join(found.entries.select(key(F.col("word")).alias("k")), F.col("word") == F.col("k"), "left_anti")
        return found.add_many(missing)

    @staticmethod
    def configured(spark: SparkSession, config: Config, path: str | None = None) -> Lexicon:
        """The list persisted at path, filled up from the TXT list of $WORD_LIST_PATH or the configuration, else from the default words; words without a score get default_base_score."""
        source = config.environment.get("WORD_LIST_PATH", config.word_list_path)
        found = Lexicon.load(spark, path, fill=False)
        more = read_txt(spark, source, config.default_base_score) if source else from_rows(spark, [{"word": w, "base_score": config.default_base_score} for w in DEFAULT_WORDS])
        known = found.entries.select(key(F.col("word")).alias("k"))
        return found.add_many(more.join(known, key(F.col("word")) == F.col("k"), "left_anti"))

    def save(self, path: str) -> None:
        self.entries.write.mode("overwrite").json(path)
        self.following().write.mode("overwrite").json(f"{path}.next")

    def add_many(self, new: DataFrame, max_words: int | None = None) -> Lexicon:
        """max_words: refuse new if the entries and its rows, known words included, are more together."""
        if max_words is not None and self.entries.count() + new.count() > max_words:
            raise ValueError(f"more than {max_words} words")
        following = self.following()
        return Lexicon(upserted(self.entries, new, following), following)

    def get(self, word: str) -> DataFrame:
        return self.entries.where(key(F.col("word")) == word.lower().strip())

    def has(self, word: str) -> bool:
        """Whether the word is listed, so that a change of one that isn't can be answered."""
        return bool(self.get(word).limit(1).count())

    def get_by_id(self, id_: int) -> DataFrame:
        return self.entries.where(F.col("id") == id_)

    def enabled(self) -> DataFrame:
        return self.entries.where("enabled")

    def update(self, word: str, base_score: float | None = None, tags: list[str] | None = None, enabled: bool | None = None) -> Lexicon:
        """Changes what is given; None keeps."""
        new = {"base_score": base_score, "tags": None if tags is None else F.array(*map(F.lit, tags)).cast("array<string>"), "enabled": enabled}
        changes = {k: F.when(key(F.col("word")) == word.lower().strip(), v).otherwise(F.col(k)) for k, v in new.items() if v is not None}
        touched = F.when(key(F.col("word")) == word.lower().strip(), F.current_timestamp()).otherwise(F.col("updated_at"))
        return Lexicon(self.entries.withColumns({**changes, "updated_at": touched}), self.used)

    def delete(self, words: list[str]) -> Lexicon:
        return self._with(self.entries.where(~key(F.col("word")).isin([w.lower().strip() for w in words])))

    def delete_by_id(self, id_: int) -> Lexicon:
        return self._with(self.entries.where(F.col("id") != id_))

    def clear(self) -> Lexicon:
        return self._with(self.entries.where("false"))

    def page(self, page: int = 1, size: int = 50) -> DataFrame:
        return self.entries.orderBy("ord").offset((page - 1) * size).limit(size)

    def count(self) -> int:
        return self.entries.count()

    def word_map(self) -> DataFrame:
        """(word, base_score) of enabled entries, lower-cased."""
        return self.enabled().select(F.lower("word").alias("word"), "base_score")

    def patterns(self) -> DataFrame:
        """(word, base_score, tags, ord) of enabled entries, lower-cased."""
        return self.enabled().select(F.lower("word").alias("word"), "base_score", "tags", "ord").where("word <> ''")
