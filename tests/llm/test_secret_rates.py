"""Planted keys: how many the entropy windows catch, how much of clean texts they take, and how time grows with spans."""

import random
import string
import time

import pytest
from pyspark.sql import functions as F

from oracles import DATA
from trendloom.llm import secrets

CLASSES = {"hex": "0123456789abcdef", "upper hex": "0123456789ABCDEF", "alnum": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "url": string.ascii_letters + string.digits + "_-"}


def planted(texts, draw, each=120):
    """(doc_id, text, class, start, end): a random key of 20 to 64 characters (lower hex up to 31, beyond which a pattern has it) in a text, between two of its words."""
    out = []
    for kind, letters in CLASSES.items():
        for _ in range(each):
            key = ""
            while not any(c.isdigit() for c in key) or not any(c.isalpha() for c in key):
                key = "".join(draw.choice(letters) for _ in range(draw.randrange(20, 32 if kind == "hex" else 65)))
            words = draw.choice(texts).split(" ")
            at = draw.randrange(len(words) + 1)
            front = "".join(w + " " for w in words[:at])
            out.append((len(out), front + key + "".join(" " + w for w in words[at:]), kind, len(front), len(front) + len(key)))
    return out


@pytest.mark.skipif(not (DATA / "sf0.001").is_dir(), reason="no tables here")
def test_planted_keys_are_caught(spark):
    texts = [r["text"] for r in spark.read.parquet(str(DATA / "sf0.001" / "documents.parquet")).where("length(text) between 50 and 4000").collect()]
    rows = planted(texts, random.Random(11))
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    clean = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select(F.size(F.filter("spans", lambda s: s["kind"] == 3)).alias("n")).agg(F.sum("n")).first()[0]
    caught = dict.fromkeys(CLASSES, 0)
    for doc_id, _, kind, start, end in rows:
        caught[kind] += any(s["start"] < end and start < s["end"] for s in found[doc_id])
    print("caught", {k: n / 120 for k, n in caught.items()}, "false spans", clean, "in", len(texts))
    assert all(n >= 0.9 * 120 for n in caught.values()), caught
    assert clean <= 0.01 * len(texts)


def test_redaction_takes_time_in_proportion(spark):
    def seconds(n):
        draw = random.Random(n)
        text = " ".join(f"password=abcd{i:06d}x and {''.join(draw.choice('abcdef0123456789') for _ in range(32))} then" for i in range(n // 2))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        row = secrets.scan(docs).select(F.size("spans").alias("n"), secrets.redact(F.col("text"), F.col("spans")).alias("t")).first()
        assert row["n"] == n and row["t"] == " ".join(["[REDACTED] and [REDACTED] then"] * (n // 2))
        return time.time() - began

    seconds(1000)
    few, many = seconds(12_500), seconds(50_000)
    assert many < 4 * few + 8


def test_redaction_of_odd_spans(spark):
    spans = lambda *xs: [(a, 0, b) for a, b in xs]
    text = "ab😀é" * 3000
    cases = [(text, spans((0, 4), (4, 6), (5, 9), (20, 20), (4095, 4098), (9000, 12000))), (text, spans((0, 12000))), (text, []), ("", []), (None, []), ("abc", spans((1, 2)))]
    cases.append((text, spans(*((8 * i, 8 * i + 5) for i in range(1400)))))
    got = spark.createDataFrame(cases, "text string, spans array<struct<start:int,kind:int,end:int>>").select("text", "spans", secrets.redact(F.col("text"), F.col("spans"), "#").alias("got")).collect()
    for r in got:
        want, at = [], -1
        for s in r["spans"]:
            if s["start"] > at:
                want += [r["text"][max(at, 0) : s["start"]], "#"]
            at = max(at, s["end"])
        assert r["got"] == ("".join(want) + r["text"][max(at, 0) :] if r["text"] is not None else None)
