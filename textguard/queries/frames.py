"""Frames the queries run on, all derived by Spark from the given tables.

The tables hold invented prose with hardly any second person in it. To let the rules speak, each
sentence of each conversation turn is joined with one of the carrier lines below, so the messages
are as many and as varied as the table is large.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import text as T
from textguard.functions.arrays import words
from textguard.operators.context import with_context
from textguard.operators.normalize import normalize
from textguard.operators.tier0 import signals
from textguard.session import checkpoint_dir

CARRIERS = [
    "you are such an idiot", "what a loser", "this keyboard is stupid", "go kill yourself now",
    "i could just die of laughter", "he called me a moron at lunch", "i want to die", "go die",
    "your stupid charger broke", "ur so dumb lol", "you're so weird haha i love it", "that film was trash",
    "nobody asked", "no one asked me about the trip", "my brother is a clown", "i am such a mess and a loser",
    "f*ck this homework", "k y s", "damn the bus is late", "i will hurt you", "you suck at chess",
    "you suck", "brave of you to post it", "idiot you are", "your face is disgusting", "you are not stupid at all",
    "nobody likes you", "love you loser", "l0ser", "stuuupid", "y0u @re tr@sh", "shut up", "shut up that is great",
    "i know where you live", "watch your back", "accidents happen", "it would be a shame if it broke",
    "you're dead", "you're dead tired", "i'm going to destroy you", "kill you know who", "i hate you",
    "everyone hates you here", "go to hell", "stfu loser", "piss off", "your mom is a cow", "imagine being this ugly",
    "you will never be loved", "waste of oxygen", "you look like a potato", "go back to your country",
    "you mean nothing", "everyone is laughing at you", "you have no friends", "ugly as hell", "get a life",
    "skill issue", "womp womp", "touch grass", "who invited you", "leave the chat", "we don't want you here",
    "bless your heart", "good for you for trying", "must be nice to not care", "actually wow congrats",
    "with all due respect", "if i were you i would be careful", "we all know", "i hate myself", "i'm so alone",
    "nothing matters anymore", "everyone would be better off without me", "i am worthless",
    "don't call people that", "the word is banned", "it is not ok to say that", "they said i was fat",
    "just kidding you clown", "nobody will ever love you", "you absolute dork", "u brat", "bruh u such a dummy",
    "she is a witch", "they are idiots", "sisters are annoying", "how pathetic", "not a loser", "summa cum laude",
    "send nudes", "sexy photo", "wtf", "lmao that game", "holy crap", "bullshit answer", "retarded idea",
    "you retard", "that spaz again", "you cripple", "you tried your best i guess", "cute that you think so",
    "thanks so much for helping", "see you at practice tonight", "can you send the notes",
    "i'm proud of you", "what do you think about it", "die", "rot in hell", "kys", "loooooser", "id1ot",
    "a55hole", "b!tch please", "n0body cares", "wh*re", "sh#t", "id**t", "my dad is a liar but smart",
    "you deserve to suffer", "your parents must be ashamed", "i'll find you", "you better watch",
]

DAY = "2024-01-01"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/textguard/{uuid.uuid4().hex}/{name}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """A table of texts. Scoring is heavy per row: splits are made small by ``spark.sql.files.maxPartitionBytes``, not by a shuffle."""
    return table(spark, sf, name).select(*columns)


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """One message per sentence of every conversation turn: msg_id, conv_id, seq, role, ts, text.

    Ids are packed from conversation, turn and place. From 100,000 turns in a conversation or sentences in a turn on they would
    collide, so the job ends there with a message instead.
    """
    turns = text_table(spark, sf, "conversations", "conv_id", "turn", "role", "text").select("conv_id", "turn", "role", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    n = len(CARRIERS)
    carrier = f"get({words(CARRIERS)}, cast((conv_id * 13 + turn * 7 + pos div 4) % {n} AS int))"
    sentence = r"regexp_replace(s, r'^\s+|\s+$', '')"
    df = turns.withColumns({
        "seq": F.expr("if(turn < 100000 AND pos < 100000, cast(turn AS bigint) * 100000 + pos, raise_error('over 100,000 turns or sentences: ids would collide'))"),
        "carrier": F.expr(carrier), "s": F.expr(sentence),
    })
    return df.select(
        F.expr("conv_id * 10000000000 + seq").alias("msg_id"), "conv_id", "seq", "role",
        F.expr(f"timestamp_seconds(unix_seconds(timestamp'{DAY} 00:00:00') + conv_id * 600 + turn * 60 + pos * 5)").alias("ts"),
        F.expr("CASE pos % 3 WHEN 0 THEN concat(carrier, ' ', s) WHEN 1 THEN concat(s, ' ', carrier)"
               " ELSE concat(s, ', ', carrier) END").alias("text"))


def messages_in_context(spark: SparkSession, sf: str) -> DataFrame:
    """Messages with their signals, and what the rules read of the conversation before each."""
    raw = messages(spark, sf)
    return with_context(signals(normalize(raw)), "conv_id", "seq", source=raw)


def activity(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as activity events."""
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").cast("string").alias("install_id"),
        F.expr("CASE event_type WHEN 'click' THEN 'caught' WHEN 'view' THEN 'covered' WHEN 'purchase' THEN 'rephrased'"
               " WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'sent_anyway' ELSE event_type END").alias("kind"),
        F.expr("least(value / 50e0, 1e0)").alias("score"),
        F.expr("CASE WHEN least(value / 50e0, 1e0) < 0.02e0 THEN NULL WHEN least(value / 50e0, 1e0) < 0.55e0 THEN 'Sharp'"
               " WHEN least(value / 50e0, 1e0) < 0.78e0 THEN 'Harsh' ELSE 'Cruel' END").alias("severity"),
        F.get_json_object("props", "$.k").cast("int").alias("text_length"),
        F.col("ts").alias("occurred_at"))


def traces(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as scoring traces: the tier that answered, and how long it took."""
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").cast("string").alias("install_id"), F.col("ts").alias("occurred_at"),
        F.to_date("ts").alias("day"),
        F.expr("CASE WHEN value < 15 THEN 'rules' WHEN value < 60 THEN 'on_device' WHEN value < 150 THEN 'context'"
               " ELSE 'cache' END").alias("tier"),
        F.col("value").alias("latency_ms"), F.expr("value >= 60 AND value < 150").alias("escalated"))


def installs(spark: SparkSession, sf: str) -> DataFrame:
    """The customers as installs; most have events, some have none."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("install_id"),
        F.expr("CASE c_custkey % 7 WHEN 0 THEN 'light' WHEN 1 THEN 'attentive' WHEN 2 THEN 'strict' ELSE 'balanced' END").alias("sensitivity"),
        F.expr("c_acctbal > 0").alias("outgoing_on"), F.expr("c_mktsegment = 'BUILDING'").alias("incoming_on"),
        F.expr("if(c_custkey % 4 = 0, NULL, sha2(concat(c_name, ':', cast(100000 + c_custkey AS string)), 256))").alias("passcode_digest"),
        F.expr("if(c_custkey % 5 = 0, NULL, c_name)").alias("passcode_salt"),
        F.expr("c_custkey % 2 = 0").alias("share_stats"),
        F.expr(f"timestamp_seconds(unix_seconds(timestamp'{DAY} 00:00:00') + (c_custkey % 20) * 86400)").alias("created_at"),
        F.expr(f"timestamp_seconds(unix_seconds(timestamp'{DAY} 00:00:00') + (20 + c_nationkey) * 86400)").alias("last_seen_at"))
