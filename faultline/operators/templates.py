"""Log template mining with a parse tree of fixed depth."""

from __future__ import annotations

import collections
import dataclasses
import hashlib
import math
import operator
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import mask, template_id, unwrap_service
from .align import asof_backward

WILD = "<*>"
_DIGIT = re.compile(r"\d")


@dataclasses.dataclass(frozen=True)
class MinerConfig:
    """Similarity that a line needs with a template, tree depth, children of a tree node at most, groups kept at most (the least recently used goes), characters that part tokens like blanks, and what stands around the names of masks."""

    similarity: float = 0.4
    depth: int = 4
    max_children: int = 100
    max_clusters: int | None = None
    delimiters: tuple[str, ...] = ()
    mask_prefix: str = "<"
    mask_suffix: str = ">"

    @classmethod
    def of(cls, settings: dict) -> MinerConfig:
        """From a parsed settings file; unknown settings are an error, absent ones keep their values."""
        names = {f.name for f in dataclasses.fields(cls)}
        if unknown := set(settings) - names:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return cls(**{k: tuple(v) if k == "delimiters" else v for k, v in settings.items()})

    def tokenised(self, content: Column) -> Column:
        """Masked, with blanks for delimiters, one blank between tokens."""
        out = F.coalesce(content, F.lit(""))
        out = F.when(out.rlike("[0-9]"), mask(out)).otherwise(out)  # no mask fits without a digit
        if (self.mask_prefix, self.mask_suffix) != ("<", ">"):
            out = F.regexp_replace(out, F.lit("<([A-Z*:]+)>"), F.lit(re.sub(r"([\\$])", r"\\\1", self.mask_prefix) + "$1" + re.sub(r"([\\$])", r"\\\1", self.mask_suffix)))
        for d in self.delimiters:
            out = F.replace(out, F.lit(d), F.lit(" "))
        uneven = out.startswith(" ") | out.endswith(" ")
        for blank in ("  ", "\t", "\n", "\x0b", "\f", "\r"):
            uneven |= out.contains(blank)
        return F.when(uneven, F.regexp_replace(F.regexp_replace(out, r"^\s+|\s+$", ""), r"\s+", " ")).otherwise(out)


class _Leaf:
    """Groups of a leaf, found by the tokens that a similar line must share with them.

    A template of c constants takes a line that agrees in k of them, which so
    agrees in at least one of any c - k + 1. The positions of the rarest such
    tokens are the group's keys; a template of fewer than k constants has none.
    """

    def __init__(self, n: int) -> None:
        self.groups: dict[int, None] = {}
        self.index: list[dict[str, int | set[int]]] = [{} for _ in range(n)]

    def put(self, g: int, p: int, token: str) -> None:
        have = self.index[p].get(token)
        if have is None:
            self.index[p][token] = g
        elif isinstance(have, set):
            have.add(g)
        else:
            self.index[p][token] = {have, g}

    def take(self, g: int, p: int, token: str) -> None:
        have = self.index[p][token]
        if isinstance(have, set) and len(have) > 1:
            have.discard(g)
        else:
            del self.index[p][token]

    def near(self, tokens: list[str]) -> set[int]:
        """Groups with a key that the line holds."""
        out: set[int] = set()
        for known, token in zip(self.index, tokens, strict=True):
            have = known.get(token)
            if have is not None:
                if isinstance(have, set):
                    out |= have
                else:
                    out.add(have)
        return out


@dataclasses.dataclass
class _Group:
    template: list[str]
    leaf: _Leaf
    lines: list[int] = dataclasses.field(default_factory=list)
    wild: int = 0  # wildcards of the template
    keys: list[int] = dataclasses.field(default_factory=list)  # positions by which the leaf finds it, rare tokens first


class TemplateMiner:
    """Lines of one length meet in a tree over their first depth - 3 tokens; a leaf's groups merge with what is similar enough.

    A token with a digit, and any token beyond the children a node may have, goes
    to the wildcard child. Of the groups most similar to a line the one with more
    wildcards takes it; positions that differ become wildcards.
    """

    def __init__(self, config: MinerConfig = MinerConfig()) -> None:
        self.config = config
        self.roots: dict[int, dict] = {}
        self.groups: list[_Group] = []
        self.used: collections.OrderedDict[int, None] = collections.OrderedDict()  # live groups, the last used last
        self.seen: dict[str, list] = {}  # tokens of the templates opened: the one copy kept, and how often
        self.least: dict[int, int] = {}

    def _leaf(self, tokens: list[str], grow: bool) -> _Leaf | None:
        node = self.roots.setdefault(len(tokens), {}) if grow else self.roots.get(len(tokens))
        if node is None:
            return None
        for token in tokens[: self.config.depth - 3]:
            key = WILD if _DIGIT.search(token) else token
            if key not in node:
                if not grow:
                    if WILD not in node:
                        return None
                    key = WILD
                elif key != WILD:
                    room = self.config.max_children - (WILD not in node)
                    key = key if len(node) < room else WILD
                if key not in node:
                    node[key] = {}
            node = node[key]
        if grow and "" not in node:
            node[""] = _Leaf(len(tokens))
        return node.get("")

    def _needed(self, n: int) -> int:
        """Tokens in which a line of n must agree: the fewest whose share is at least the similarity."""
        if n not in self.least:
            k = max(0, math.ceil(self.config.similarity * n) - 1)
            while k / n < self.config.similarity:
                k += 1
            self.least[n] = k
        return self.least[n]

    def match(self, tokens: list[str]) -> int | None:
        leaf = self._leaf(tokens, False)
        if leaf is None:
            return None
        needed = self._needed(len(tokens))
        near = leaf.near(tokens) if needed else leaf.groups
        if near and WILD in tokens:
            tokens = [None if t == WILD else t for t in tokens]  # agrees with nothing
        best, best_key = None, (needed, -1, 0)
        for g in near:
            group = self.groups[g]
            same = sum(map(operator.eq, group.template, tokens))
            if same >= best_key[0] and (key := (same, group.wild, -g)) > best_key:
                best, best_key = g, key
        return best

    def add(self, line: int, tokens: list[str]) -> int:
        """Group of the line. Lines of at most one token only join equal ones."""
        g = self.find(tokens)
        if g is None:
            g = self.open(tokens)
        elif self.groups[g].template != tokens:
            self._widen(self.groups[g], g, tokens)
        self.groups[g].lines.append(line)
        self.used[g] = None
        self.used.move_to_end(g)
        return g

    def _keys(self, group: _Group) -> int:
        """How many of its constants must be keys."""
        n = len(group.template)
        return n if n < 2 else max(0, n - group.wild - max(1, self._needed(n)) + 1)

    def _widen(self, group: _Group, g: int, tokens: list[str]) -> None:
        """Positions that differ become wildcards, and keys no longer needed go, the commonest first."""
        old, group.template = group.template, [a if a == b else WILD for a, b in zip(group.template, tokens, strict=True)]
        group.wild = group.template.count(WILD)
        keys = [p for p in group.keys if group.template[p] != WILD][: self._keys(group)]
        for p in set(group.keys).difference(keys):
            group.leaf.take(g, p, old[p])
        group.keys = keys

    def open(self, tokens: list[str]) -> int:
        """A new group of this template; beyond the groups kept, the least recently used leaves the tree."""
        if self.config.max_clusters is not None and len(self.used) >= self.config.max_clusters:
            old, _ = self.used.popitem(last=False)
            gone = self.groups[old]
            for p in gone.keys:
                gone.leaf.take(old, p, gone.template[p])
            del gone.leaf.groups[old]
        known = [self.seen.setdefault(t, [t, 0]) for t in tokens]
        for k in known:
            k[1] += 1
        g = len(self.groups)
        group = _Group([k[0] for k in known], self._leaf(tokens, True), wild=tokens.count(WILD) if len(tokens) > 1 else 0)
        constant = [p for p, t in enumerate(tokens) if t != WILD or len(tokens) < 2]
        group.keys = sorted(constant, key=lambda p: known[p][1])[: self._keys(group)]
        for p in group.keys:
            group.leaf.put(g, p, group.template[p])
        group.leaf.groups[g] = None
        self.groups.append(group)
        self.used[g] = None
        return g

    def find(self, tokens: list[str]) -> int | None:
        """Group that a line matches, without learning from it."""
        if len(tokens) > 1:
            return self.match(tokens)
        leaf = self._leaf(tokens, False)
        return None if leaf is None else min(leaf.near(tokens) if tokens else leaf.groups, default=None)

    def template(self, g: int) -> str:
        return " ".join(self.groups[g].template)


def mine(lines: DataFrame, line_id: str = "line_id", content: str = "content", config: MinerConfig = MinerConfig(), running: bool = False) -> DataFrame:
    """Adds event_id, template, occurrence (so far, of the template) to lines(line_id, content, ...).

    The tree's state is separate per number of tokens, so that is the grouping.
    Equal masked lines are mined once, at their first appearance - a repeat can
    neither open a group nor change a template - so a group holds distinct lines
    only; it goes back to the lines by its SHA-256, so texts are shuffled once a
    step. The template is the group's last, or with ``running`` that at the line.
    """
    masked = config.tokenised(F.col(content))
    keyed = lines.withColumn("_k", F.coalesce(F.unhex(F.sha2(masked, 256)), F.lit(b"")))  # never null, or the join would work it out once more to see
    distinct = lines.select(masked.alias("_m"), line_id).groupBy("_m").agg(F.min(line_id).alias("_first")).withColumn("_n", F.when(F.col("_m") == "", 0).otherwise(F.size(F.split("_m", " "))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        miner = TemplateMiner(config)
        pdf = pdf.sort_values("_first")
        found, now = [], []
        for first, text in zip(pdf["_first"], pdf["_m"], strict=True):
            g = miner.add(first, text.split(" ") if text else [])
            found.append(g)
            if running:
                now.append(miner.template(g))
        out = {"_k": [hashlib.sha256(text.encode()).digest() for text in pdf["_m"]], "template": [miner.template(g) for g in found]}
        return pd.DataFrame(out | {"_n": pdf["_n"], "_first": pdf["_first"], "_g": found, "_now": now} if running else out)

    first = f"{line_id} {lines.schema[line_id].dataType.simpleString()}".replace(line_id, "_first", 1)
    mined = distinct.groupBy("_n").applyInPandas(run, "_k binary, template string" + f", _n int, {first}, _g int, _now string" * running)
    if running:
        changes = mined.select("_n", "_g", F.col("_first").alias(line_id), F.col("_now").alias("template"))
        out = asof_backward(keyed.join(mined.select("_k", "_n", "_g"), "_k"), changes, ["_n", "_g"], line_id, "template")
    else:
        out = keyed.join(mined, "_k")
    out = out.drop("_k", "_n", "_g").withColumn("event_id", template_id(F.col("template")))
    return out.withColumn("occurrence", F.row_number().over(Window.partitionBy("event_id").orderBy(line_id)))


def catalogue(mined: DataFrame) -> DataFrame:
    """(event_id, template, occurrence), most frequent first."""
    return mined.groupBy("event_id", "template").agg(F.count("*").alias("occurrence")).orderBy(F.desc("occurrence"), "event_id")


def numbered(mined: DataFrame, line_id: str = "line_id") -> DataFrame:
    """Adds cluster_id, from 1 by the first line of each template: the number that mining line by line would give."""
    first = mined.groupBy("event_id").agg(F.min(line_id).alias("_first"))
    ids = first.select("event_id", F.row_number().over(Window.orderBy("_first")).alias("cluster_id"))  # a row per template
    return mined.join(ids, "event_id")


def save_catalogue(catalogue_: DataFrame, path: str) -> None:
    """Stores (event_id, template, occurrence) as Parquet: the miner's state."""
    catalogue_.select("event_id", "template", "occurrence").write.mode("overwrite").parquet(path)


def load_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def match_only(lines: DataFrame, catalogue_: DataFrame, content: str = "content", config: MinerConfig = MinerConfig()) -> DataFrame:
    """Adds event_id and template by a stored catalogue, null where no template is similar enough; nothing is learned.

    The catalogue, whose size ``max_clusters`` or the first mining bounds, goes to
    every task; lines are matched where they lie, without a shuffle.
    """
    rows = [(r["event_id"], r["template"]) for r in catalogue_.select("event_id", "template", "occurrence").orderBy(F.desc("occurrence"), "event_id").toLocalIterator()]
    shared = lines.sparkSession.sparkContext.broadcast(rows)

    @F.pandas_udf("struct<event_id:string,template:string>")
    def match(text: pd.Series) -> pd.DataFrame:
        miner = TemplateMiner(config)
        for _, template in shared.value:
            miner.open(template.split(" ") if template else [])
        known: dict[str, int | None] = {}
        out = []
        for t in text:
            if t not in known:
                known[t] = miner.find(t.split(" ") if t else [])
            out.append(shared.value[known[t]] if known[t] is not None else (None, None))
        return pd.DataFrame(out, columns=["event_id", "template"])

    return lines.withColumn("_e", match(config.tokenised(F.col(content)))).select("*", "_e.event_id", "_e.template").drop("_e")


def template_of(events: DataFrame, catalogue_: DataFrame) -> DataFrame:
    """``events`` with the template of their event_id, empty where it is unknown."""
    return events.join(catalogue_.select("event_id", "template").dropDuplicates(["event_id"]), "event_id", "left").withColumn("template", F.coalesce("template", F.lit("")))


def parse_events(logs: DataFrame, catalogue_: DataFrame, log: str = "log", pod: str = "pod", config: MinerConfig = MinerConfig()) -> DataFrame:
    """``logs`` with service, message, event_id and template: container lines are unwrapped by their service's rule, then matched."""
    message, service = unwrap_service(F.col(log), F.col(pod))
    return match_only(logs.withColumn("service", service).withColumn("message", message), catalogue_, "message", config)


def mine_online(stream: DataFrame, line_id: str = "line_id", content: str = "content", config: MinerConfig = MinerConfig()) -> DataFrame:
    """(line_id, event_id, template): the miner as the state of a stream, one tree per number of tokens; the template is the one at that moment."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    tokenised = stream.withColumn("_m", config.tokenised(F.col(content))).withColumn("_n", F.when(F.col("_m") == "", 0).otherwise(F.size(F.split("_m", " "))))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        miner = TemplateMiner(config)
        for template in state.get[0] if state.exists else ():
            miner.open(list(template))
        pdf = pd.concat(list(parts)).sort_values(line_id)
        found = [miner.template(miner.add(i, t.split(" ") if t else [])) for i, t in zip(pdf[line_id], pdf["_m"], strict=True)]
        state.update(([miner.groups[g].template for g in miner.used],))
        yield pd.DataFrame({line_id: pdf[line_id], "template": found})

    types = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = tokenised.groupBy("_n").applyInPandasWithState(step, f"{line_id} {types[line_id]}, template string", "templates array<array<string>>", "append", GroupStateTimeout.NoTimeout)
    return out.withColumn("event_id", template_id(F.col("template")))
