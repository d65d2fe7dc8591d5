"""From capture files to filtered captures, reports, and explained captures."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import aggregates, answers, chunking, context, decode, embedding, flows, report, search, signals
from ..sources.pcap import read_captures, write_captures
from ..sources.rules import Rules


@dataclass
class Capture:
    """The tables of decoded and judged captures."""

    raw: DataFrame
    packets: DataFrame
    verdicts: DataFrame
    flows: DataFrame
    totals: DataFrame


def judge(raw: DataFrame, rules: Rules) -> Capture:
    """Decodes frames, follows their flows and applies the rules."""
    packets = decode.transport_packets(raw)
    judged = kept(flows.judged_packets(packets, rules))
    verdicts = kept(flows.verdicts(judged, rules))
    counted = judged.join(verdicts.select("capture", "packet_no", "reason"), ["capture", "packet_no"])
    return Capture(raw, packets, verdicts, kept(flows.engine_flows(judged, verdicts)), aggregates.capture_totals(counted))


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder, where the session names one: several tables are made from them."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; of our own only where the session names none and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="flowloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def filter_captures(spark: SparkSession, source: str, target: str, rules: Rules) -> Capture:
    """Writes what the rules let through: frames whose packet isn't dropped. Frames that are no TCP or UDP over IPv4 are left out."""
    made = judge(read_captures(spark, source), rules)
    passed = made.verdicts.where("reason is null").select("capture", "packet_no")
    write_captures(made.raw.join(passed, ["capture", "packet_no"]), target)
    return made


@dataclass
class Explained:
    records: DataFrame
    signals: DataFrame
    queries: DataFrame
    excerpts: DataFrame
    answers: DataFrame | None


def explain(made: Capture, knowledge: DataFrame, encoder: embedding.Encoder, client=None, settings: Settings = Settings()) -> Explained:
    """Reports, signals, the excerpts that go with them, and (with a client) a checked answer for each capture.

    knowledge: (document_id, category, title, section, text). All queries of all captures are searched together.
    """
    records = report.flow_records(made.flows, settings.address_mode, settings.max_flows)
    unknown = made.flows.groupBy("capture").agg(F.count_if(F.col("app") == "Unknown").alias("unknown_flows"))
    records = kept(records)
    fired = signals.signals(records, made.totals.select("capture", "dropped_packets").join(unknown, "capture"))
    fired = kept(fired)
    queries = answers.signal_queries(fired, signals.profile(records))
    chunks = chunking.chunks(knowledge)
    index = search.joined(chunks, embedding.embed_chunks(chunks, encoder))
    vectors = queries.select(F.concat_ws("\x1f", "capture", "label").alias("label"), embedding.encode(answers.with_prefix(F.col("text")), encoder).alias("vector"))
    hits = search.search(vectors, index, top_k=4).withColumn("capture", F.split_part("label", F.lit("\x1f"), F.lit(1))).withColumn("label", F.split_part("label", F.lit("\x1f"), F.lit(2)))
    place = index.select("chunk_id", "document_id", "category", "section", "text", chunking.citation(F.col("document_id"), F.col("section"), F.col("chunk_index"), F.col("chunk_count")).alias("citation"))
    ranked = search.select_chunks(search.merge(hits, ["capture"]).join(place, "chunk_id"), by=["capture"])
    ranked = ranked.withColumn("matched", F.array_sort(F.transform(F.filter(F.map_keys("per_query"), lambda k: k.startswith("signal:")), lambda k: F.regexp_replace(k, "^signal:", ""))))
    sized = ranked.withColumn("size", F.length(context.rendered(F.lit("K"))))
    taken = context.fit_budget(sized, settings.max_items, settings.max_chars, settings.max_tokens)
    excerpts = kept(ranked.join(taken, ["capture", "chunk_id"]))
    if client is None:
        return Explained(records, fired, queries, excerpts, None)
    text = context.render_records(records, ["flow_id", "protocol", "dst_port", "server_name", "application", "state", "verdict", "bytes_out", "bytes_in"])
    block = context.render_block(excerpts.where("position is not null"))
    requests = text.select("capture", F.col("text").alias("flows")).join(block.select("capture", F.col("text").alias("knowledge")), "capture", "left")
    given = answers.checked(answers.parsed(answers.ask(requests, client, settings.max_input_tokens)), records, excerpts)
    return Explained(records, fired, queries, excerpts, given)


def report_text(made: Capture) -> str:
    """The captures' reports as one text, in order of their names, for the command line; report.capture_texts has them as rows."""
    return "\n".join(r.text for r in report.capture_texts(made.totals, made.flows).orderBy("capture").toLocalIterator())
