"""Small case of a finding of round 3 on the pipeline: texts that share a passage don't pair up."""

import random

from pyspark.sql import functions as F

from chalkline.llm import simhash


def test_texts_of_a_common_passage_meet_at_rare_shingles(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    texts = [" ".join(passage + [word() for _ in range(16 + i % 9)]) for i in range(150)]
    texts += [x + " " + word() for x in texts[:20]]  # near copies of twenty of them
    sets = [set(simhash.shingle_set(simhash.shingle_hashes(x)).tolist()) for x in texts]
    like = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) >= simhash.SIMILARITY * len(sets[i] | sets[j])}
    docs = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string").withColumn("sha", F.unhex(F.sha2("text", 256)))
    met = simhash._may_be_similar(docs.select("node", F.col("node").alias("cluster")), docs.select("node", "sha"), docs.select("sha", "text"))
    pairs = {tuple(sorted(r)) for r in met.collect()}
    assert {(i, 150 + i) for i in range(20)} <= like <= pairs
    assert len(pairs) < 100  # of 14,365
