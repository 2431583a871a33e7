"""Cut token sequences into typed records, left to right without overlap.

The scan of an encounter is a chain: whether a record may start at a token depends on where the
last one ended. To keep even a huge encounter distributed, its tokens are cut into chunks of
fixed size. A chunk can only be entered at one of the first few tokens, so it is summed up as a
small table "entered at offset s -> leaves at offset t after n records". These tables are
composed in a tree, which gives every chunk its entry, and each chunk is then cut on its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.functions.text import is_number, is_zero, matches
from kohorta.operators.ordered import join_null_safe, number_rows, top_rows
from kohorta.session import checked_broadcast, materialize

# Attribute names of the three kinds of content.
LAB_ATTRIBUTES = ("LeistID", "Kat", "Value", "Unit", "Date", "Time", "LOINC", "range_low", "range_high")
TREATMENT_ATTRIBUTES = ("Type", "Code", "Descr", "Date", "Time")
HEADER_ATTRIBUTES = ("admission", "discharge", "oe_admission", "oe_discharge", "encounter_type",
                     "DRG_Code_Aufn")


@dataclass(frozen=True)
class Rules:
    """Where a record shows its zero time and what its other marks look like."""
    lab_zero_at: int = 5
    lab_head: str = "._|MIN|IM|M[0-9]|WAU|WGA"
    treatment_zero_at: int = 4
    treatment_text_at: int = 2
    treatment_text_longer_than: int = 5
    allow_final: bool = False
    lab: tuple[str, ...] = field(default=LAB_ATTRIBUTES)
    treatment: tuple[str, ...] = field(default=TREATMENT_ATTRIBUTES)

    @property
    def reach(self) -> int:
        return max(len(self.lab), len(self.treatment))


def with_positions(tokens: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Dense 0-based positions within an encounter.

    Where ``value`` is an array of tokens that follow each other, the first column of ``order`` is the place of the first one, and missing
    tokens have no position. The array of an encounter that has no other stays one row and need not be moved; the tokens of
    all others are numbered one by one.
    """
    if _holds_runs(tokens):
        at = order[0]
        several = materialize(tokens.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*keys))
        shared, alone = None, tokens
        if not several.isEmpty():
            several = checked_broadcast(several)
            shared, alone = (join_null_safe(tokens, several, keys, how) for how in ("left_semi", "left_anti"))
        alone = alone.withColumns({"value": F.filter("value", lambda v: v.isNotNull()), "pos": F.lit(0).cast("bigint")})
        if shared is None:
            return alone
        cells = shared.select(*[c for c in tokens.columns if c != "value"], F.posexplode("value").alias("__at", "value")).where(
            "value is not null").withColumn(at, F.col(at) + F.col("__at")).drop("__at")
        return alone.unionByName(with_positions(cells, keys, order).withColumn("value", F.array("value")))
    numbered = number_rows(tokens, keys, order, "__no")
    return numbered.withColumn("pos", F.col("__no") - 1).drop("__no")


def _holds_runs(tokens: DataFrame) -> bool:
    return dict(tokens.dtypes)["value"].startswith("array")


def _runs(tokens: DataFrame) -> DataFrame:
    """Tokens as runs: ``value`` an array of tokens that follow each other, of one token where tokens came one a row."""
    return tokens if _holds_runs(tokens) else tokens.withColumn("value", F.array("value"))


def _chunked(tokens: DataFrame, keys: Sequence[str], rules: Rules, size: int) -> DataFrame:
    """One row per chunk: its tokens and a look-ahead from the next chunk, how many are its own, and
    the places where a record could start, with the record's length."""
    runs = _runs(tokens).where(F.size("value") > 0)
    home = F.expr(f"pos div {size}")
    ahead = (home > 0) & (F.col("pos") % size < rules.reach)
    touched = F.sequence(F.when(ahead, home - 1).otherwise(home), F.expr(f"(pos + size(value) - 1) div {size}"))
    placed = runs.select(*keys, "pos", "value", F.explode(F.coalesce(touched, F.array(F.lit(None).cast("bigint")))).alias("chunk"))
    # a run travels whole, cut to the chunk and its look-ahead; it is taken apart where the chunk is put together
    low = F.greatest(F.col("chunk") * size - F.col("pos"), F.lit(0))
    high = F.least((F.col("chunk") + 1) * size + rules.reach - F.col("pos"), F.size("value"))
    cut = F.coalesce(F.slice("value", (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")), F.col("value"))
    placed = placed.select(*keys, "chunk", F.struct((F.col("pos") + F.coalesce(low, F.lit(0))).alias("pos"), cut.alias("values")).alias("t"))

    def token(pos: Column, value: Column) -> Column:
        return F.struct(
            pos.alias("pos"), value.alias("value"),
            matches(value, rules.lab_head).alias("head"), is_zero(value).alias("zero"),
            ((F.length(value) > rules.treatment_text_longer_than) & ~is_number(value)).alias("text"))
    every = F.flatten(F.transform("runs", lambda r: F.transform(r["values"], lambda v, i: token(r["pos"] + i, v))))
    chunks = placed.groupBy(*keys, "chunk").agg(F.collect_list("t").alias("runs")).withColumn("ts", F.sort_array(every)).drop("runs")
    own = F.least(F.size("ts"), F.lit(size))
    margin = 0 if rules.allow_final else 1

    def step(i: Column) -> Column:
        def at(offset: int, name: str) -> Column:
            return F.coalesce(F.get("ts", i + offset)[name], F.lit(False))
        lab = ((i + len(rules.lab) - 1 + margin < F.size("ts"))
               & at(rules.lab_zero_at, "zero") & at(0, "head"))
        treatment = ((i + len(rules.treatment) - 1 + margin < F.size("ts"))
                     & at(rules.treatment_zero_at, "zero") & at(rules.treatment_text_at, "text"))
        length = F.when(lab, F.lit(len(rules.lab))).when(treatment, F.lit(len(rules.treatment)))
        return F.struct(i.alias("i"), length.alias("s"))

    starts = F.filter(F.transform(F.sequence(F.lit(0), own - 1), step), lambda c: c["s"].isNotNull())
    return chunks.withColumns({"own": own, "starts": starts})


def _walk(entry: Column) -> Column:
    """Leave offset and record count of a chunk entered at ``entry``."""
    start = F.struct(entry.cast("int").alias("at"), F.lit(0).cast("bigint").alias("n"))
    moved = F.aggregate("starts", start, lambda acc, c: F.when(
        c["i"] >= acc["at"], F.struct((c["i"] + c["s"]).alias("at"), (acc["n"] + 1).alias("n"))).otherwise(acc))
    return F.struct(F.greatest(moved["at"] - F.col("own"), F.lit(0)).cast("int").alias("at"), moved["n"].alias("n"))


def _then(acc: Column, table: Column) -> Column:
    hop = F.get(table, acc["at"])
    return F.struct(hop["at"].alias("at"), (acc["n"] + hop["n"]).alias("n"))


def _start(offset) -> Column:
    return F.struct(F.lit(offset).cast("int").alias("at"), F.lit(0).cast("bigint").alias("n"))


def _entries(chunks: DataFrame, keys: Sequence[str], last_chunk: int, reach: int, fan: int) -> DataFrame:
    """(keys, chunk, entry): compose the chunk tables upwards, hand the entries downwards."""
    tables = chunks.select(*keys, F.col("chunk").alias("node"),
                           F.array(*[_walk(F.lit(s)) for s in range(reach)]).alias("f"))
    level, levels = materialize(tables), []
    while last_chunk > 0:
        kids = level.groupBy(*keys, F.expr(f"node div {fan}").alias("parent")).agg(
            F.sort_array(F.collect_list(F.struct("node", "f"))).alias("kids"))
        kids = materialize(kids.withColumn("f", F.array(*[
            F.aggregate("kids", _start(s), lambda acc, k: _then(acc, k["f"])) for s in range(reach)])))
        levels.append(kids)
        level = kids.select(*keys, F.col("parent").alias("node"), "f")
        last_chunk //= fan
    entry = level.select(*keys, "node", _start(0).alias("entry"))
    for kids in reversed(levels):
        first = F.struct(F.col("entry").alias("acc"), F.array().cast(
            "array<struct<node:bigint,entry:struct<at:int,n:bigint>>>").alias("out"))
        handed = F.aggregate("kids", first, lambda s, k: F.struct(
            _then(s["acc"], k["f"]).alias("acc"),
            F.concat(s["out"], F.array(F.struct(k["node"].alias("node"), s["acc"].alias("entry")))).alias("out")))
        joined = kids.drop("f").join(entry.withColumnRenamed("node", "parent"), [*keys, "parent"])
        entry = joined.select(*keys, F.inline(handed["out"]))
    return entry.withColumnRenamed("node", "chunk")


def segment_records(tokens: DataFrame, keys: Sequence[str], rules: Rules = Rules(), chunk_size: int = 1024,
                    fan: int = 1024) -> DataFrame:
    """(keys, rec_no, rec_type, attr, seq, value) of every record found in ``tokens(keys, pos, value)``.

    A row may hold an array of tokens that follow each other, ``pos`` being the place of the first: they travel together.
    """
    if chunk_size < rules.reach:
        raise ValueError(f"chunk_size must be at least {rules.reach}")
    keys = list(keys)
    last = _runs(tokens).agg(F.max(F.col("pos") + F.size("value") - 1)).first()[0]
    chunks = _chunked(tokens, keys, rules, chunk_size)
    if last is not None and last >= chunk_size:
        chunks = materialize(chunks)
        entries = _entries(chunks, keys, last // chunk_size, rules.reach, fan)
        chunks = chunks.join(entries, [*keys, "chunk"])
    else:
        chunks = chunks.withColumn("entry", _start(0))
    blank = F.struct(F.col("entry")["at"].alias("at"), F.array().cast("array<struct<i:int,s:int>>").alias("hits"))
    hits = F.aggregate("starts", blank, lambda acc, c: F.when(
        c["i"] >= acc["at"],
        F.struct((c["i"] + c["s"]).alias("at"), F.concat(acc["hits"], F.array(c)).alias("hits"))
    ).otherwise(acc))["hits"]
    records = chunks.select(*keys, "entry", "ts", F.posexplode(hits).alias("k", "hit"))
    is_lab = F.col("hit.s") == len(rules.lab)
    names = F.when(is_lab, F.array(*[F.lit(a) for a in rules.lab])).otherwise(
        F.array(*[F.lit(a) for a in rules.treatment]))
    cells = F.transform(F.slice("ts", F.col("hit.i") + 1, F.col("hit.s")), lambda t: t["value"])
    return records.select(
        *keys, (F.col("entry.n") + F.col("k") + 1).alias("rec_no"),
        F.when(is_lab, "lab").otherwise("treatment").alias("rec_type"), names.alias("names"),
        F.posexplode(cells).alias("seq", "value")
    ).select(*keys, "rec_no", "rec_type", F.get("names", F.col("seq")).alias("attr"), "seq", "value")


def header_attributes(tokens: DataFrame, keys: Sequence[str],
                      names: Sequence[str] = HEADER_ATTRIBUTES) -> DataFrame:
    """The leading tokens of each encounter under their names."""
    labels = F.array(*[F.lit(n) for n in names])
    return tokens.where(F.col("pos") < len(names)).select(
        *keys, F.get(labels, F.col("pos").cast("int")).alias("attr"), "value")


def leading_attributes(tokens: DataFrame, keys: Sequence[str], order: Sequence[str],
                       names: Sequence[str] = HEADER_ATTRIBUTES) -> DataFrame:
    """The same from tokens without positions: each task keeps the first few tokens of an encounter before the shuffle. With
    arrays of tokens as values it keeps the first few arrays, cut, and their tokens count in the order of (order, place)."""
    labels = F.array(*[F.lit(n) for n in names])
    by = [F.col(c) for c in order]
    if dict(tokens.dtypes)["value"].startswith("array"):
        cut = tokens.where(F.size("value") > 0).withColumn("value", F.slice("value", 1, len(names)))
        runs = top_rows(cut, keys, by, len(names)).groupBy(*keys).agg(F.collect_list(F.struct(*order, "value")).alias("__runs"))
        every = F.flatten(F.transform("__runs", lambda r: F.transform(r["value"], lambda v, i: F.struct(
            *[r[c].alias(c) for c in order], i.alias("__at"), v.alias("value")))))
        return runs.select(*keys, F.posexplode(F.slice(F.sort_array(every), 1, len(names))).alias("__place", "t")).select(
            *keys, F.get(labels, F.col("__place")).alias("attr"), F.col("t.value").alias("value"))
    first = top_rows(tokens, keys, by, len(names), "__place")
    return first.select(*keys, F.get(labels, (F.col("__place") - 1).cast("int")).alias("attr"), "value")
