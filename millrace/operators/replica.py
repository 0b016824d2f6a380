"""Questions about a replicated log: quorum, lag, merging of nodes' reports, differences and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import scalars as S
from millrace.schema import QUORUM_CONTACT_MS, RPC_BYTES, RPC_ENTRIES, STALE_PROPOSAL_MS
from millrace.storage import durable, small


def quorum_commit(replicas: DataFrame, by: list[str], match: str = "match_index") -> DataFrame:
    """The greatest index that a majority of each cluster's replicas (the leader among them) has reached; clusters are small."""
    high_first = Window.partitionBy(*by).orderBy(F.desc(match))
    ranked = replicas.withColumn("_n", F.row_number().over(high_first)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return ranked.where(F.col("_n") == F.floor(F.col("_all") / 2) + 1).select(*by, F.col(match).alias("commit_index"))


def follower_sync(peers: DataFrame, matches: DataFrame, commit: int | Column, key: str = "node_id") -> DataFrame:
    """peers with match_index (0 where unknown), lag, and the cluster's sync percentage."""
    c = F.lit(commit) if isinstance(commit, int) else commit
    out = peers.join(matches, key, "left").withColumn("match_index", F.coalesce("match_index", F.lit(0)))
    out = out.withColumn("lag", F.greatest(F.lit(0), c - F.col("match_index")).cast("long"))
    worst = F.max("lag").over(Window.partitionBy(F.lit(0)))  # one row a peer
    return out.withColumn("sync", S.clamp(100 - F.floor(worst * 100 / 1000), 0, 100).cast("long"))


def message_lag(followers: DataFrame, entries: DataFrame, commit: int, exact: int = 2000, rate: float | None = None) -> DataFrame:
    """Messages in the log entries (index, batch_size) after each follower's match_index, up to commit; -1 where that is unknown.

    Beyond `exact` entries it is an estimate, by a tenth of the rate or 50 messages an entry.
    Entries are summed up once, and looked up at each match index.
    """
    per_entry = max(1.0, rate / 10) if rate else 50.0
    recent = entries.where((F.col("index") > commit - exact) & (F.col("index") <= commit))  # at most `exact` rows
    # A match index needn't be that of an entry: each stands among the entries, before those of its own index.
    marks = followers.where("match_index is not null").select(F.col("match_index").alias("index"), F.lit(0).cast("long").alias("batch_size"), F.lit(0).alias("_entry")).distinct()
    both = recent.select(F.col("index").cast("long").alias("index"), F.col("batch_size").cast("long").alias("batch_size"), F.lit(1).alias("_entry")).unionByName(marks)
    after = F.sum("batch_size").over(Window.orderBy(F.desc("index"), "_entry").rowsBetween(Window.unboundedPreceding, 0))
    sums = both.withColumn("_after", after).where("_entry = 0").select(F.col("index").alias("match_index"), "_after")
    out = followers.join(F.broadcast(sums), "match_index", "left")
    behind = F.lit(commit) - F.col("match_index")
    lag = F.when(F.col("match_index").isNull(), -1).when(behind <= 0, 0).when(behind <= exact, F.coalesce("_after", F.lit(0))).otherwise(F.floor(behind * per_entry))
    return out.withColumn("message_lag", lag.cast("long")).drop("_after")


def merge_nodes(reports: DataFrame) -> DataFrame:
    """One row a node from reports (reporter, node_id, state, term, lag): its own report counts, but for the lag, which the leader knows.

    The leader is the LEADER with the greatest term; LEADERs of smaller terms are shown as followers.
    """
    everything = Window.partitionBy(F.lit(0))  # a row for each pair of nodes
    is_own = F.col("reporter") == F.col("node_id")
    leader = F.max(F.when(is_own & (F.col("state") == "LEADER"), F.struct("term", "reporter"))).over(everything)
    known = reports.withColumn("_top", F.max("term").over(everything)).withColumn("_leader", leader["reporter"])
    best = known.groupBy("node_id").agg(
        F.max_by(F.struct("state", "term"), F.struct(is_own.cast("int"), "term", "reporter")).alias("_best"),
        F.max(F.when(~is_own & (F.col("reporter") == F.col("_leader")), F.col("lag"))).alias("_told"),
        F.max(F.when(is_own, F.col("lag"))).alias("_own"),
        F.max("_top").alias("_top"),
    )
    stale = (F.col("_best.state") == "LEADER") & (F.col("_best.term") < F.col("_top"))
    return best.select("node_id", F.when(stale, "FOLLOWER").otherwise(F.col("_best.state")).alias("state"), F.col("_best.term").alias("term"), F.coalesce("_told", "_own").alias("lag"))


def reachable_followers(nodes: DataFrame) -> DataFrame:
    """Nodes other than leaders whose lag isn't negative; an unknown lag counts as reachable."""
    return nodes.where((F.col("state") != "LEADER") & F.coalesce(F.col("lag") >= 0, F.lit(True)))


def compaction_bound(nodes: DataFrame, threshold: int) -> DataFrame:
    """nodes (leader, applied, match_index) to the index that the leader's log may be cut at: what followers lack stays, within 2 thresholds."""
    bounds = nodes.groupBy("leader").agg(F.max("applied").alias("applied"), F.min("match_index").alias("least"))
    bound = F.least(F.greatest(F.col("applied") - 2 * threshold, F.col("least")), F.col("applied") - threshold)
    return bounds.select("leader", "applied", F.col("least").alias("min_match"), bound.cast("long").alias("bound"))


def log_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: the first index at which two logs (index, term) differ or one of them ends; null if they are equal."""
    both = left.select("index", F.col("term").alias("_l")).join(right.select("index", F.col("term").alias("_r")), "index", "full")
    return both.where(~F.col("_l").eqNullSafe(F.col("_r"))).agg(F.min("index").alias("first_difference"))


def quorum_alive(peers: DataFrame, now_ms: Column, within_ms: int = QUORUM_CONTACT_MS) -> DataFrame:
    """For each cluster of peers (cluster, contact_ms, in_snapshot): this node and the peers heard of lately, and whether they are a majority."""
    heard = F.col("in_snapshot") | (F.col("contact_ms") >= now_ms - within_ms)
    out = peers.groupBy("cluster").agg((1 + F.count(F.when(heard, 1))).alias("alive"), S.majority(F.count(F.lit(1))).alias("needed"))
    return out.withColumn("has_quorum", F.col("alive") >= F.col("needed"))


def rpc_prefix(entries: DataFrame, by: list[str], size: str, most: int = RPC_ENTRIES, most_bytes: int = RPC_BYTES, start: int | None = None) -> DataFrame:
    """The entries that one request takes, from each log's first on, or from its index `start`: up to most rows and most_bytes, but at least one."""
    entries = entries.where(F.col("index") >= start) if start is not None else entries
    order = Window.partitionBy(*by).orderBy("index")
    first = entries.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)  # cut in each task before the exchange
    out = first.withColumn("_bytes", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where((F.col("_n") == 1) | (F.col("_bytes") <= most_bytes)).drop("_n", "_bytes")


def stale_proposals(proposals: DataFrame, now_ms: Column, most_ms: int = STALE_PROPOSAL_MS) -> DataFrame:
    return proposals.where(now_ms - F.col("proposed_ms") > most_ms)


def settle_proposals(proposals: DataFrame, applied: DataFrame) -> DataFrame:
    """Pending proposals (index, term) against applied entries: settled where the terms agree, lost where they don't."""
    found = proposals.join(applied.select("index", F.col("term").alias("_term")), "index")
    return found.withColumn("settled", F.col("term") == F.col("_term")).drop("_term")


def replay(raft_log: DataFrame, commit: int) -> tuple[DataFrame, DataFrame]:
    """Messages and committed offsets that the committed entries of a log (schema.RAFT_ENTRY) make."""
    from millrace.operators.log import assign_offsets

    done = raft_log.where(F.col("index") <= commit)
    messages = assign_offsets(done.where("command_type = 'MESSAGE'"), ["index"])
    commits = done.where("command_type = 'OFFSET_COMMIT'").groupBy(F.col("consumer_group").alias("group"), "topic").agg(F.max_by("offset_value", "index").alias("committed"))
    return messages.select("offset", "topic", "payload", "key", "timestamp"), commits


def votes(requests: DataFrame, nodes: DataFrame, now_ms: Column, within_ms: int = 2000) -> DataFrame:
    """What nodes answer to a request each (node, term, candidate, last_index, last_term): pre_vote and vote, and the term after the vote.

    nodes: node, current_term, voted_for, own_index, own_term, is_leader, heartbeat_ms (0 or null: none yet). A vote takes a term not below the
    node's own, no vote for another in it, and a log as new as its own; a newer term forgets the vote given before. A pre-vote
    takes a newer term, no leader heard of lately, and the same of the log.
    """
    both = requests.join(nodes, "node")
    new_log = S.up_to_date(F.col("last_term"), F.col("last_index"), F.col("own_term"), F.col("own_index"))
    newer = F.col("term") > F.col("current_term")
    free = newer | F.col("voted_for").isNull() | (F.col("voted_for") == F.col("candidate"))
    heard = F.coalesce(F.col("heartbeat_ms"), F.lit(0))
    alive = F.col("is_leader") | ((heard > 0) & (now_ms - heard < within_ms))
    return both.select(
        "node", "candidate", (newer & ~alive & new_log).alias("pre_vote"),
        ((F.col("term") >= F.col("current_term")) & free & new_log).alias("vote"), F.greatest("term", "current_term").alias("term"),
    )


def _bounded(entries: DataFrame, cuts: DataFrame, log: str) -> DataFrame:
    """entries with the cut of their log (log, at; null where there is none) and its first and last index; a row a log is sent along."""
    bounds = entries.groupBy(log).agg(F.min("index").alias("_first"), F.max("index").alias("_last"))
    return entries.join(small(durable(bounds.join(cuts.select(log, F.col("at").alias("_at")), log))), log, "left")


def truncate_from(entries: DataFrame, cuts: DataFrame, log: str) -> DataFrame:
    """entries without those of a log from its cut on; a cut outside the log changes nothing."""
    gone = (F.col("_at") >= F.col("_first")) & (F.col("_at") <= F.col("_last")) & (F.col("index") >= F.col("_at"))
    return _bounded(entries, cuts, log).where(~F.coalesce(gone, F.lit(False))).select(entries.columns)


def compact(entries: DataFrame, cuts: DataFrame, log: str) -> DataFrame:
    """entries without those of a log up to its cut, that one too; a cut at or before the first index or beyond the last changes nothing."""
    gone = (F.col("_at") > F.col("_first")) & (F.col("_at") <= F.col("_last")) & (F.col("index") <= F.col("_at"))
    return _bounded(entries, cuts, log).where(~F.coalesce(gone, F.lit(False))).select(entries.columns)
