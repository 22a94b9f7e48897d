"""Digests of proofs, which are moved instead of whole proofs."""

import hashlib

from pyspark.sql import functions as F

from tidemark.operators import pins as K


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_proof_digests(spark):
    tiers = K.merkle_levels(spark.range(37).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("leaf")), depth=2)
    found = K.proof_digests(tiers, 2)
    assert not [c for c, kind in found.dtypes if "array" in kind]
    want, h = {}, sorted(sha(str(k)) for k in range(37))
    leaves, steps, at = h, [""] * 37, list(range(37))
    while len(h) > 1:
        steps = [s + ("<" + h[i - 1] if i % 2 else ">" + (h[i + 1] if i + 1 < len(h) else h[i])) for s, i in zip(steps, at)]
        h, at = [sha(h[k] + (h[k + 1] if k + 1 < len(h) else h[k])) for k in range(0, len(h), 2)], [i // 2 for i in at]
    want = {(leaf, 6, sha(s), True) for leaf, s in zip(leaves, steps)}
    assert {tuple(r) for r in found.collect()} == want
