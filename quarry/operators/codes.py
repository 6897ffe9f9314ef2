"""Reject causes of two networks, looked up by number with a default; and the guides, as static tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table

#: fixed values: cause numbers and names of the two networks' standards
LTE = {
    2: "IMSI unknown in HSS", 3: "Illegal UE", 5: "IMEI not accepted", 6: "Illegal ME", 7: "EPS services not allowed", 8: "EPS services and non-EPS services not allowed",
    9: "UE identity cannot be derived by the network", 10: "Implicitly detached", 11: "PLMN not allowed", 12: "Tracking Area not allowed", 13: "Roaming not allowed in this tracking area",
    14: "EPS services not allowed in this PLMN", 15: "No Suitable Cells In tracking area", 16: "MSC temporarily not reachable", 17: "Network failure", 18: "CS domain not available", 19: "ESM failure",
    20: "MAC failure", 21: "Synch failure", 22: "Congestion", 23: "UE security capabilities mismatch", 24: "Security mode rejected, unspecified", 25: "Not authorized for this CSG",
    26: "Non-EPS authentication unacceptable", 31: "Redirection to 5GCN required", 35: "Requested service option not authorized in this PLMN", 39: "CS service temporarily not available",
    40: "No EPS bearer context activated", 42: "Severe network failure", 78: "PLMN not allowed to operate at the present UE location", 95: "Semantically incorrect message", 96: "Invalid mandatory information",
    97: "Message type non-existent or not implemented", 98: "Message type not compatible with protocol state", 99: "Information element non-existent or not implemented", 100: "Conditional IE error",
    101: "Message not compatible with protocol state", 111: "Protocol error, unspecified",
}
FIVE_G = {
    3: "Illegal UE", 5: "PEI not accepted", 6: "Illegal ME", 7: "5GS services not allowed", 9: "UE identity cannot be derived by the network", 10: "Implicitly de-registered", 11: "PLMN not allowed",
    12: "Tracking area not allowed", 13: "Roaming not allowed in this tracking area", 15: "No suitable cells in tracking area", 20: "MAC failure", 21: "Synch failure", 22: "Congestion",
    23: "UE security capabilities mismatch", 24: "Security mode rejected, unspecified", 26: "Non-5G authentication unacceptable", 27: "N1 mode not allowed", 28: "Restricted service area",
    31: "Redirection to EPC required", 62: "No network slices available", 65: "Maximum number of PDU sessions reached", 67: "Insufficient resources for specific slice and DNN",
    69: "Insufficient resources for specific slice", 71: "ngKSI already in use", 72: "Non-3GPP access to 5GCN not allowed", 73: "Serving network not authorized", 74: "Temporarily not authorized for this SNPN",
    75: "Permanently not authorized for this SNPN", 76: "Not authorized for this CAG", 90: "Payload was not forwarded", 91: "DNN not supported or not subscribed in the slice", 95: "Semantically incorrect message",
    96: "Invalid mandatory information", 97: "Message type non-existent or not implemented", 98: "Message type not compatible with protocol state", 99: "Information element non-existent or not implemented",
    100: "Conditional IE error", 101: "Message not compatible with protocol state", 111: "Protocol error, unspecified",
}
DEFAULT = 111


def causes(spark: SparkSession) -> DataFrame:
    """(network, number, name, spec): a table of fixed size."""
    rows = [(n, k, v, s) for n, s, t in (("lte", "TS 24.301", LTE), ("5g", "TS 24.501", FIVE_G)) for k, v in t.items()]
    return spark.createDataFrame(rows, "network string, number int, name string, spec string")


def look_up(asked: DataFrame) -> DataFrame:
    """(network, asked; number, name, spec, note): numbers that are not defined are those of the default, with a note."""
    known = causes(asked.sparkSession)
    found = asked.join(F.broadcast(known.withColumnRenamed("number", "asked")), ["network", "asked"], "left")
    other = known.where(F.col("number") == DEFAULT).select("network", F.col("name").alias("d_name"), F.col("spec").alias("d_spec"))
    missing = F.col("name").isNull()
    return found.join(F.broadcast(other), "network").select(
        "network", "asked", F.when(missing, DEFAULT).otherwise(F.col("asked")).alias("number"), F.coalesce("name", "d_name").alias("name"), F.coalesce("spec", "d_spec").alias("spec"),
        F.when(missing, F.concat(F.lit("cause "), F.col("asked").cast("string"), F.lit(" is not defined"))).alias("note"),
    )


def cause(spark, sf_dir: str, number: int, network: str = "lte") -> dict:
    """A cause as a record, with up to two texts that name it."""
    from .search import search

    row = look_up(spark.createDataFrame([(network, number)], "network string, asked int")).first().asDict()
    if row["note"] is None:
        row["evidence"] = [r["content"][:400] for r in search(spark, sf_dir, row["name"], max_results=2, mode="keyword")["results"]]
    return row


@query("SELECT CAST(p_partkey % 120 AS INTEGER) AS asked, network, CASE WHEN p_partkey % 120 IN (7, 22, 100) OR p_partkey % 120 = 2 AND network = 'lte' OR p_partkey % 120 = 62 AND network = '5g' THEN CAST(p_partkey % 120 AS INTEGER) ELSE 111 END AS number, count(*) AS n FROM part, (SELECT unnest(['lte', '5g']) AS network) WHERE p_partkey % 120 IN (0, 1, 2, 7, 22, 62, 100, 111, 112) AND NOT (p_partkey % 120 = 111 AND FALSE) GROUP BY ALL")
def code_lookup(spark, sf_dir):
    """Numbers of both networks, defined and not."""
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 120).cast("int").alias("asked")).where(F.col("asked").isin(0, 1, 2, 7, 22, 62, 100, 111, 112))
    both = rows.withColumn("network", F.explode(F.array(F.lit("lte"), F.lit("5g"))))
    return look_up(both).groupBy("asked", "network", "number").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES (7, 'lte', 'EPS services not allowed', 'TS 24.301', NULL), (7, '5g', '5GS services not allowed', 'TS 24.501', NULL), (999, 'lte', 'Protocol error, unspecified', 'TS 24.301', 'cause 999 is not defined'), (2, '5g', 'Protocol error, unspecified', 'TS 24.501', 'cause 2 is not defined'), (91, '5g', 'DNN not supported or not subscribed in the slice', 'TS 24.501', NULL)) AS t(asked, network, name, spec, note)")
def cause_names(spark, sf_dir):
    asked = spark.createDataFrame([("lte", 7), ("5g", 7), ("lte", 999), ("5g", 2), ("5g", 91)], "network string, asked int")
    return look_up(asked).select("asked", "network", "name", "spec", "note")


#: how to bring documents in, by kind
GUIDES = {
    "catalog": "Read directory listings with graph.listing, keep ranges, then documents, versions and files; upsert each table by its key and go on with the last unfinished run of the scope.",
    "delivery": "Choose documents with deliveries.selected_documents, write the plan as tab-separated lines, fetch the files, build sections with ingest.spans and append them with mutations.",
    "memo": "Read texts with files.read_texts, cut them with ingest.memo_sections, join the metadata by number and replace the rows of that document.",
    "retrieval": "Build the index with postings.Index.build, vectors with ingest.update_index, and keep both up to date from a stream with streaming.state.maintain_index.",
}


def guide(kind: str) -> dict[str, str]:
    """One guide, or all of them."""
    if kind != "all" and kind not in GUIDES:
        raise ValueError(f"no guide {kind}")
    return dict(GUIDES) if kind == "all" else {kind: GUIDES[kind]}


@query("SELECT unnest(['catalog', 'delivery', 'memo', 'retrieval']) AS kind, 4 AS guides")
def guides(spark, sf_dir):
    found = guide("all")
    return spark.createDataFrame([(k, len(found)) for k in found], "kind string, guides int")
