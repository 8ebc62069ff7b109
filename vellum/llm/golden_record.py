"""Golden records: one surviving record for each cluster of client rows, hot clusters apart from cold ones.

Clusters are counted exactly. Those of up to `hot` rows (cold) are dealt by a hash of their id into groups of about
`GROUP_ROWS` rows, and pandas picks the survivors of all clusters of a group at once, by stable sorts. Those above are
reduced as trees of Spark aggregates: a cluster's rows are dealt to leaves of about `LEAF_ROWS` by a hash, each leaf
keeps its best candidates (a maximum of structs whose first fields are the order), and `FAN` nodes at a time meet in
the next one, so no task reads more of a hot cluster than of another. What depends on the cluster (its latest
update, its chosen segment) comes back to the leaves by a join on (cluster, leaf). Both ways give the same rows.

Which clusters are hot is a table of ids and counts, at most one for every `hot` rows; it meets the rows in a plain
equi-join, whose hot keys adaptive execution splits, and nothing is broadcast but what Spark's own size check lets through.

The rules. Text that is empty or white space is null. RECENT: latest updated_at (null last), higher trust, smaller client_id
(null last). TRUSTED: fresh before stale, higher trust, then RECENT. A record is stale without updated_at, or
`STALE` before its cluster's latest. Sources that are not listed, null too, have the least trust.
segment by RECENT; email by TRUSTED; name by most code points, then TRUSTED; balance from the chosen segment first, then
RECENT, each the first that is not null. city and nation_id come from one record: most of both, then RECENT.

Ties beyond these rules (rows that repeat a client_id, time and source) go to the greater value. Rows with neither id
form one cluster with a null id. A null client_id supplies a value without a name for its origin. A balance that is
NaN, infinite or too great for a whole number of cents may be the one chosen, and has null cents. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch

#: Sources by falling trust.
TRUST = ["store", "crm", "partner", "web"]
STALE = 10 * 24 * 3600 * 1_000_000
HOT, GROUP_ROWS, LEAF_ROWS, FAN = 1_000, 4_096, 4_096, 32
BLANK = " \t\n\x0b\x0c\r"
KEY = ["no_cluster", "cluster"]
RECORD = "cluster_id long, n_records long, n_stale long, name string, email string, segment string, city string, nation_id int, balance double, name_from long, email_from long, segment_from long, balance_from long, address_from long"


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 as the clock on the wall shows them, whatever the session's zone."""
    at = df[column]
    if dict(df.dtypes)[column] != "timestamp_ntz":
        return F.unix_micros(at.cast("timestamp"))
    second = F.unix_date(at.cast("date")).cast("long") * 86_400 + F.hour(at) * 3_600 + F.minute(at) * 60
    return second * 1_000_000 + (F.date_part(F.lit("SECOND"), at) * 1_000_000).cast("long")


def prepared(clients: DataFrame) -> DataFrame:
    """The columns that the rules look at, under names of their own."""
    text = lambda c: F.when(F.btrim(clients[c].cast("string"), F.lit(BLANK)) != "", clients[c].cast("string"))
    cluster, client = F.coalesce(clients["master_id"], clients["client_id"]).cast("long"), clients["client_id"].cast("long")
    trust = F.coalesce(F.array_position(F.array(*map(F.lit, TRUST)), text("source")), F.lit(0))
    return clients.select(
        cluster.isNull().alias("no_cluster"), F.coalesce(cluster, F.lit(0)).alias("cluster"), client.alias("client"), micros(clients, "updated_at").alias("at"),
        F.when(trust > 0, len(TRUST) + 1 - trust).otherwise(0).alias("trust"), *(text(c).alias(c) for c in ("name", "email", "segment", "city")),
        clients["nation_id"].cast("int").alias("nation_id"), clients["balance"].cast("double").alias("balance"),
    )


# ---- cold clusters


def _first(cluster: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """The row of each cluster that comes first by falling values of `order`, by a stable sort; -1 where the first of these is below zero for all its rows."""
    by = np.lexsort([-x.astype(np.int64) for x in reversed(order)] + [cluster])
    rows = by[np.flatnonzero(np.diff(cluster[by], prepend=-1))]
    return np.where(order[0][rows] < 0, -1, rows)


def _survivors(frame: pd.DataFrame) -> pd.DataFrame:
    """One record for each cluster of a group."""
    cluster, n = frame.groupby(KEY, sort=False).ngroup().to_numpy(), len(frame)
    code = {c: pd.factorize(frame[c], sort=True)[0] for c in ("name", "email", "segment", "city", "nation_id")}  # -1: null
    for c in ("at", "balance"):
        code[c] = np.where(frame[f"has_{c}"], np.unique(frame[c], return_inverse=True)[1], -1)
    trust, client = frame["trust"].to_numpy(), np.where(frame["has_client"], ~frame["client"].to_numpy(), np.iinfo(np.int64).min)
    at = np.where(frame["has_at"], frame["at"].to_numpy(), np.iinfo(np.int64).min)
    latest = np.full(cluster.max() + 1, np.iinfo(np.int64).min)
    np.maximum.at(latest, cluster, at)
    fresh = (frame["has_at"].to_numpy() & (at >= latest[cluster] - STALE)).astype(int)
    client = pd.factorize(client, sort=True)[0]
    recent = code["at"], trust, client
    trusted = fresh, trust, *recent
    there = {c: np.where(code[c] < 0, -1, 0) for c in code}
    length = frame["name"].str.len().fillna(-1).to_numpy(dtype=np.int64)
    segment = _first(cluster, there["segment"], *recent, code["segment"])
    chosen = np.where(segment < 0, -1, code["segment"][segment])
    address = _first(cluster, (code["city"] >= 0) * 1 + (code["nation_id"] >= 0), *recent, code["city"], code["nation_id"])
    rows = {
        "name": _first(cluster, length, *trusted, code["name"]), "email": _first(cluster, there["email"], *trusted, code["email"]), "segment": segment,
        "balance": _first(cluster, there["balance"], code["segment"] == chosen[cluster], *recent, code["balance"]), "address": address,
    }
    ids = frame["client"].astype("Int64").where(frame["has_client"])
    first = pd.Series(np.arange(n)).groupby(cluster).first().to_numpy()
    out = {"cluster_id": frame["cluster"].astype("Int64").where(~frame["no_cluster"]).take(first).reset_index(drop=True), "n_records": np.bincount(cluster), "n_stale": np.bincount(cluster, 1 - fresh).astype(np.int64)}

    def taken(c: str, at_rows: np.ndarray):
        values = frame[c].astype({"nation_id": "Int64", "balance": "float64"}.get(c, object))
        got = values.take(np.maximum(at_rows, 0)).reset_index(drop=True)
        return got.where(pd.Series(at_rows >= 0) & got.notna(), None if got.dtype == object else pd.NA if c == "nation_id" else np.nan)

    for c, source in (("name", "name"), ("email", "email"), ("segment", "segment"), ("city", "address"), ("nation_id", "address"), ("balance", "balance")):
        out[c] = taken(c, rows[source])
    filled = (code["city"][address] >= 0) | (code["nation_id"][address] >= 0)
    for c, r in rows.items():
        out[f"{c}_from"] = ids.take(np.maximum(r, 0)).reset_index(drop=True).where(pd.Series((r >= 0) & (filled if c == "address" else True)))
    return pd.DataFrame(out)[[x.split()[0] for x in RECORD.split(", ")]]


def _cold(rows: DataFrame, groups: int) -> DataFrame:
    """Whole numbers that may be null, and balances that may be NaN, go to pandas beside a flag."""
    for flag, c in (("has_at", "at"), ("has_client", "client"), ("has_balance", "balance")):
        rows = rows.withColumn(flag, F.col(c).isNotNull()).withColumn(c, F.coalesce(c, F.lit(0)))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64(*KEY), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(_survivors, RECORD)


# ---- hot clusters


def _tree(leaves: DataFrame, key: list[str], width: int, best: list[str], sums: list[str]) -> DataFrame:
    """Reduces (key, node) to key: FAN nodes at a time, maxima of `best` and sums of `sums`."""
    while True:
        leaves = leaves.groupBy(*key, "node").agg(*(F.max(c).alias(c) for c in best), *(F.sum(c).alias(c) for c in sums))
        if width <= 1:
            return leaves.drop("node")
        width = -(-width // FAN)
        leaves = leaves.withColumn("node", F.floor(F.col("node") / FAN))


def _hot(rows: DataFrame, hot: DataFrame, scratch: Scratch, leaf_rows: int) -> DataFrame:
    """`hot`: key and n of the hot clusters."""
    leaves = F.ceil(F.col("n") / leaf_rows)
    width = hot.agg(F.max(leaves)).first()[0] or 1
    dealt = rows.join(hot, KEY).withColumn("node", F.monotonically_increasing_id() % leaves).drop("n")
    dealt = scratch.write(dealt, "hot")  # from here on a row's leaf is fixed; which it is changes no result
    recent = [F.col("at").alias("at"), F.col("trust").alias("trust"), F.bitwise_not("client").alias("client")]
    have = lambda c, *order: F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("value"))).alias(c)
    full = F.col("city").isNotNull().cast("int") + F.col("nation_id").isNotNull().cast("int")
    first = dealt.select(*KEY, "node", F.lit(1).alias("n_records"), "at", have("segment", *recent), F.struct(full.alias("full"), *recent, "city", "nation_id").alias("address"))
    chosen = scratch.write(_tree(first, KEY, width, ["at", "segment", "address"], ["n_records"]), "chosen").withColumnsRenamed({"at": "latest", "segment": "best"})
    beside = chosen.join(hot, KEY).select(*KEY, F.explode(F.sequence(F.lit(0).cast("long"), leaves - 1)).alias("node"), "latest", "best.value")
    dealt = dealt.join(beside, [*KEY, "node"])
    fresh = F.coalesce(F.col("at") >= F.col("latest") - STALE, F.lit(False)).cast("int")
    trusted = [fresh.alias("fresh"), F.col("trust").alias("trusted"), *recent]
    second = dealt.select(
        *KEY, "node", (1 - fresh).alias("n_stale"), have("email", *trusted), have("name", F.char_length("name").alias("length"), *trusted),
        have("balance", F.col("segment").eqNullSafe(F.col("value")).alias("same"), *recent),
    )
    best = chosen.join(_tree(second, KEY, width, ["email", "name", "balance"], ["n_stale"]), KEY).withColumnRenamed("best", "segment")
    return best.select(
        F.when(~F.col("no_cluster"), F.col("cluster")).alias("cluster_id"), "n_records", "n_stale",
        *(F.col(f"{c}.value").alias(c) for c in ("name", "email", "segment")), "address.city", "address.nation_id", F.when(~F.isnan("balance.value"), F.col("balance.value")).alias("balance"),
        *(F.bitwise_not(f"{c}.client").alias(f"{c}_from") for c in ("name", "email", "segment", "balance")), F.when(F.col("address.full") > 0, F.bitwise_not("address.client")).alias("address_from"),
    )


def golden_records(clients: DataFrame, hot: int = HOT, group_rows: int = GROUP_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One record for each cluster: the columns of RECORD, and balance_cents."""
    scratch, rows = Scratch(clients.sparkSession, "golden-record"), prepared(clients)
    counts = rows.groupBy(*KEY).agg(F.count("*").alias("n"))
    heavy = scratch.write(counts.where(F.col("n") > hot), "clusters")
    groups = max(1, -(-rows.count() // group_rows))
    cold = _cold(rows.join(heavy, KEY, "left_anti"), groups)
    found = cold.unionByName(_hot(rows, heavy, scratch, leaf_rows))
    cents = F.floor(F.col("balance") * 100 + 0.5)
    return found.withColumn("balance_cents", F.when(F.abs("balance") < 9e16, cents).cast("long"))
