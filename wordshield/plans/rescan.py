"""Reports brought up to date after a change of the word list: only messages that the change can touch are scanned again."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.cached import built_once
from ..operators import rowwise, wordlist
from ..operators.fuzzy import distance_of
from ..sources.lexicon import Lexicon
from .scan import KEYS, prepared, scan


@dataclass(frozen=True)
class Rescan:
    """reports: those of a full scan with the new list. touched: the keys of the messages that were scanned again."""

    reports: DataFrame
    touched: DataFrame

    def release(self) -> None:
        self.touched.unpersist()


def changed_words(old: Lexicon, new: Lexicon) -> DataFrame:
    """(word, base_score, tags, ord) of every enabled entry that only one of the lists has in this form."""
    before, after = old.patterns(), new.patterns()
    return before.subtract(after).unionByName(after.subtract(before))


@built_once
def _fuzzy_changes(config: Config, options: bool) -> Column:
    """Whether the fuzzy stage can answer otherwise for a message in which no reading holds a changed word.

    Its detected words are then the same, so the same tokens are eligible. It can only differ if other tokens are within the
    budget, or if one that is compared is near a changed word.
    """
    most = F.coalesce(F.col("options.max_distance"), F.lit(config.fuzzy.max_distance)) if options else F.lit(config.fuzzy.max_distance)
    low = F.lower("n")

    def differs(open_: Column) -> Column:
        before, after = (rowwise.compared_tokens(open_, F.col(c), config.fuzzy, most) for c in ("old_counts", "new_counts"))
        close = lambda t: F.exists(rowwise.near_lengths(t["token"], F.col("changed_words"), most), lambda w: distance_of(t["token"], w["word"], most, config.fuzzy.distance) >= 0)
        places = lambda xs: F.transform(xs, lambda x: x["k"])
        return (places(before) != places(after)) | F.exists(after, close)

    differing = F.get(F.transform(F.array(rowwise.eligible_tokens(low, F.col("words"), config.fuzzy)), differs), 0)
    return rowwise.wanted("fuzzy", config, options) & differing


def rescan(messages: DataFrame, reports: DataFrame, old: Lexicon, new: Lexicon, config: Config | None = None, *, id_col: str = "message_id", text_col: str = "text", unique: bool = False) -> Rescan:
    """The reports of scan(messages, new), given those of scan(messages, old) with the same configuration.

    A message is scanned again if one of its readings holds a word that was added, removed, switched or changed, if such a
    word is near one of its tokens, if the fuzzy budget now reaches other tokens, or if it has no report. All others keep
    theirs. Changed words are found by an anchor search, as long lists are; the lists should follow from one another by the
    changes of Lexicon, which leave other entries' places as they are.
    """
    config = config or Config()
    changed = changed_words(old, new)
    ready = prepared(messages, config, id_col, text_col, unique)
    options = "options" in ready.columns
    found = F.array_distinct(F.transform(F.filter("detections", lambda d: d["method"] != "fuzzy"), lambda d: d["word"]))
    keyed = reports.withColumn("text_key", F.xxhash64("text"))
    met = ready.join(keyed.select(*KEYS, found.alias("words")), KEYS, "left")
    held = wordlist.candidates(ready, changed, config, KEYS, "auto").select(*KEYS)
    of = lambda listed, fuzzy: wordlist.lengths_of(listed, fuzzy)
    every = of(changed, replace(config.fuzzy, max_checks=1 << 30)).select(F.col("lengths.words").alias("changed_words"))
    beside = [every] + [of(x.patterns(), config.fuzzy).select(F.col("lengths.counts").alias(c)) for x, c in ((old, "old_counts"), (new, "new_counts"))]
    rows = met
    for one in beside:
        rows = rows.crossJoin(F.broadcast(one))  # a row each
    other = rows.where(F.col("words").isNull() | _fuzzy_changes(config, options)).select(*KEYS)
    touched = held.unionByName(other).distinct().persist(StorageLevel.MEMORY_AND_DISK)
    again = scan(ready.join(touched, KEYS, "left_semi").drop("text_key", "n", "n_length", "word_count"), new, config, unique=True, keep=False)
    kept = keyed.join(touched, KEYS, "left_anti").select(*again.reports.columns)
    return Rescan(kept.unionByName(again.reports), touched)
