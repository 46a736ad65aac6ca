import random

from corvella.llm import secrets


def test_every_window_is_learned_from_or_held_out(spark, monkeypatch):
    """With far more windows than the network begins with: the trainers see each that isn't held out, the threshold follows from all others."""
    monkeypatch.setattr(secrets, "FINDINGS", 40)
    monkeypatch.setattr(secrets, "PART", 200)
    r, seen = random.Random(8), []
    key = lambda: "".join(r.choice("abcdef0123456789ABCDEFGHIJKLMNOP") for _ in range(31)) + "7"
    docs = spark.createDataFrame([(i, f"some words of text {i} token = \"{key()}\" and /usr/share/doc/part{i}/name") for i in range(400)], "doc_id long, text string")
    learned = secrets._learned
    monkeypatch.setattr(secrets, "_learned", lambda network, rows, n, scratch: seen.append((rows.toArrow().to_pylist(), n)) or learned(network, rows, n, scratch))
    network = secrets.train(docs)
    rows, n = seen[0]
    assert len(rows) == sum(n.values()) >= 1000
    positive = sorted(network.score([x["window"] for x in rows if x["held"] and x["y"]]))
    assert network.threshold == positive[int((1 - secrets.RECALL) * len(positive))]
    again = secrets.train(docs.repartition(5))  # whatever the partitions are
    assert again.threshold == network.threshold and all((a == b).all() for a, b in zip(again.w, network.w, strict=True))
