"""Secret scans over a trigram inverted index, with DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import fits, join_spread, stored, text_of
from termweave.llm.trigrams import ALL, Query, trigram_query

#: Places of the bitmap of candidate keys, 16 MB of them whatever the corpus, and of one of its rows.
BITMAP_BITS, ROW_BITS = 2**27, 2**15
#: Texts of a shard of the index, on average; posting lists are no longer than that.
SHARD = 1024


@dataclass(frozen=True)
class Rule:
    """A match counts if its group has at least `least` characters; failing matches are passed over whole."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @property
    def query(self) -> Query:
        return trigram_query(self.pattern)

    @property
    def java(self) -> str:
        return "(?i)" * self.any_case + self.pattern


#: The first three are fixed by contract. A run of 24 or more characters is a maximal run that doesn't fail, so its length is in the pattern.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

SPAN = "struct<start:bigint,kind:int,stop:bigint>"


def text_key(text: Column) -> Column:
    """Names a text in the index. Texts that share a key share candidates; verification tells them apart."""
    return F.xxhash64(text)


def build_index(df: DataFrame, grams: list[str], text: str = "text") -> DataFrame:
    """postings(shard, gram, keys): for each trigram of the list, the texts whose lower-cased form holds it.

    Shards are dealt by key and grow in number with the rows; equal texts have one posting.
    """
    shards = max(1, math.ceil(df.count() / SHARD))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)))
    # In a projection of its own, so that a text is lowered once and not for each trigram.
    lowered = df.select(text_key(text_of(text)).alias("key"), F.lower(text_of(text)).alias("low"))
    rows = lowered.select("key", F.explode(held).alias("gram"))
    return rows.groupBy(F.pmod("key", F.lit(shards)).alias("shard"), "gram").agg(F.collect_set("key").alias("keys"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): for each text that meets a rule's trigram query, the numbers of those rules.

    Conjunctions intersect posting lists within a shard, disjunctions unite the results.
    """
    lists = index.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("postings"))
    none = F.array().cast("array<bigint>")
    postings = lambda g: F.coalesce(F.element_at("postings", F.lit(g)), none)
    hits = []
    for n, rule in enumerate(rules):
        clauses = [reduce(F.array_intersect, [postings(g) for g in sorted(clause)]) for clause in sorted(rule.query, key=sorted)]
        hits.append(F.struct(F.lit(n).alias("rule"), reduce(F.array_union, clauses).alias("keys")))
    found = lists.select(F.explode(F.array(*hits)).alias("x")).select("x.rule", F.explode("x.keys").alias("key"))
    return found.groupBy("key").agg(F.sort_array(F.collect_set("rule")).alias("rules"))


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """array of (start, kind, stop), in code points, of a rule's counting matches: leftmost, without overlap.

    The pieces between matches and the matches themselves make up the text, so running sums of their lengths
    are the positions.
    """
    pattern = F.lit(rule.java)
    match = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, rule.java, -1)
    # Arrays are zipped and not looked into by number, which would make them anew for each match. Only a rule that looks at a
    # group of its match needs to extract that, too.
    if rule.group:
        checked = F.regexp_extract_all(text, pattern, F.lit(rule.group))
        found = F.zip_with(match, checked, lambda m, c: F.struct(F.length(m).cast("bigint").alias("size"), (F.length(c) >= rule.least).alias("good")))
    else:
        found = F.transform(match, lambda m: F.struct(F.length(m).cast("bigint").alias("size"), (F.length(m) >= rule.least).alias("good")))
    parts = F.zip_with(found, gaps, lambda f, g: F.struct(F.length(g).cast("bigint").alias("gap"), f["size"].alias("size"), f["good"].alias("good")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"] + part["gap"]
        # What follows the last match has no size.
        stop = begin + F.coalesce(part["size"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(number).alias("kind"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(part["good"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.when(F.rlike(text, pattern), F.aggregate(parts, start, step, lambda acc: acc["spans"])).otherwise(F.array().cast(f"array<{SPAN}>"))


def _bitmap(hits: DataFrame) -> DataFrame:
    """(bits_row, bits): the places of all keys in a bitmap of BITMAP_BITS places, in rows of ROW_BITS; at most 16 MB."""
    place = F.pmod(F.xxhash64("key", F.lit(2)), F.lit(BITMAP_BITS))
    row = F.floor(place / ROW_BITS).cast("int").alias("bits_row")
    return hits.groupBy(row).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(ROW_BITS))).alias("bits"))


def _in_bitmap(key: Column, bits: Column) -> Column:
    place = F.pmod(F.xxhash64(key, F.lit(2)), F.lit(ROW_BITS))
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False))


def _with_rules(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """rows (row, key) with the rules that each is a candidate for; null for none.

    Few candidates are broadcast. Of more, a bitmap of their keys is; rows that it rules out stay where they are, the
    others are joined by a shuffle, copies of a text over several tasks.
    """
    if fits(hits):
        return rows.join(F.broadcast(hits), "key", "left")
    at = F.floor(F.pmod(F.xxhash64("key", F.lit(2)), F.lit(BITMAP_BITS)) / ROW_BITS).cast("int")
    marked = rows.withColumn("bits_row", at).join(F.broadcast(_bitmap(hits)), "bits_row", "left")
    marked = marked.select("row", "key", _in_bitmap(F.col("key"), F.col("bits")).alias("may"))
    some = marked.where("may").select("row", "key", F.monotonically_increasing_id().alias("place"))
    # Rows of each key: the hub test reads keys only.
    counts = stored(marked.where("may").groupBy("key").agg(F.count("*").alias("n")))
    n = counts.agg(F.sum("n")).head()[0] or 0
    met = join_spread(some, hits, "key", "place", n, "left", counts).select("row", "rules")
    return met.unionByName(marked.where("not may").select("row", F.lit(None).cast("array<int>").alias("rules")))


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", column: str = "secret_spans") -> DataFrame:
    """df with a column of spans, array of (start, kind, stop) sorted by start, then by the rule's number.

    Rules whose matches must hold some trigrams are looked up in an inverted index and only verified on candidate
    texts; the others scan every whole text. Candidates go back to the rows by the text's key (see _with_rules).

    Null texts are empty and have no spans; very long ones are scanned whole; repeated rows and equal texts have equal
    spans; a column of df with the new one's name is replaced; an empty table gives an empty one.
    """
    indexed = [(n, r) for n, r in enumerate(rules) if r.query != ALL]
    grams = sorted({g for _, r in indexed for clause in r.query for g in clause})
    df = df.drop(column)
    body = F.coalesce(F.col("row")[text], F.lit(""))
    found = [spans_of(body, r, n) for n, r in enumerate(rules) if r.query == ALL]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    if indexed:
        hits = stored(candidates(build_index(df, grams, text), tuple(r for _, r in indexed)))
        rows = _with_rules(rows.select("row", text_key(body).alias("key")), hits)
        nothing = F.array().cast(f"array<{SPAN}>")
        found += [F.when(F.array_contains("rules", i), spans_of(body, r, n)).otherwise(nothing) for i, (n, r) in enumerate(indexed)]
    return rows.withColumn("spans", F.sort_array(F.concat(*found))).select("row.*", F.col("spans").alias(column))


def described(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:stop of each span, joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def of_kinds(spans: Column, first: int, last: int) -> Column:
    return F.filter(spans, lambda s: (s["kind"] >= first) & (s["kind"] <= last))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by the mark; null stays null."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.when((s["start"] > acc["at"]) | (acc["out"] == ""), F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), new.otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
