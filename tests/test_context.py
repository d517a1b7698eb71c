import random

from trussline.operators import context


def plain(sizes, b):
    """Repacks everything for each section, as the definition says."""

    def chunks(chosen):
        out, now = [], 0
        for size in chosen:
            if now and -(-(now + size) // 4) > b.chunk_tokens:
                out.append(now)
                now = 0
            now = now + size if now else len(b.header.format(len(out) + 1)) + size
        return out + [now] if now else out

    chosen, taken = [], []
    for size in sizes:
        fits = False
        if -(-size // 4) <= b.chunk_tokens:
            made = chunks([*chosen, size])
            links = sum(len(b.link.format(k + 1)) for k in range(len(made)))
            n = len(chosen) + 1
            index = b.index_bytes + links + len(str(n)) + len(str(len(sizes) - n))
            fits = -(-index // 4) + sum(-(-x // 4) for x in made) <= b.tokens
        taken.append(fits)
        if fits:
            chosen.append(size)
    return taken, chunks(chosen)


def test_packing_equals_repacking(spark):
    r = random.Random(1)
    data, want = [], {}
    for p in range(12):
        budget_sizes = [r.choice([40, 200, 900, 5000]) + r.randrange(60) for _ in range(r.randrange(1, 60))]
        want[p] = budget_sizes
        data += [(p, k, f"r{k}", s, len(budget_sizes)) for k, s in enumerate(budget_sizes)]
    r.shuffle(data)
    b = context.Budget(tokens=2000, chunk_tokens=400)
    df = spark.createDataFrame(data, "package_id int, place int, record_id string, size long, total long")
    got = {p: [] for p in want}
    for row in context.pack(df, b).orderBy("package_id", "place").collect():
        got[row.package_id].append(row.chunk)
    for p, sizes in want.items():
        taken, made = plain(sizes, b)
        assert [c is not None for c in got[p]] == taken
        assert max([c or 0 for c in got[p]], default=0) == len(made)


def test_profiles(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("entity",), ("source",), ("odd",), (None,)], "t string")
    assert [r[0] for r in df.select(context.priority(F.col("t"), "agent")).collect()] == [1, 0, 9, 9]
    assert [r[0] for r in df.select(context.priority(F.col("t"), "audit")).collect()] == [4, 0, 9, 9]


def test_rendered_contexts_keep_their_budget(spark):
    from pyspark.sql import functions as F

    r = random.Random(2)
    data = [(p, k, f"r{k}", f"{k:03d}" + "é" * r.randrange(400)) for p in ("a", "b") for k in range(40)]
    sections = spark.createDataFrame(data, "package_id string, place int, record_id string, section string").withColumns({"size": F.octet_length("section").cast("long"), "total": F.lit(40).cast("long")})
    packages = spark.createDataFrame([("a", "d", "{}", "[]"), ("b", "d", "{}", '["' + "x" * 3000 + '"]'), ("c", None, None, None)], "package_id string, logical_digest string, capabilities string, losses string")
    b = context.Budget(tokens=2000, chunk_tokens=400)
    files = {}
    for row in context.render(sections, packages, "audit", b).collect():
        assert row.tokens == -(-len(row.content.encode()) // 4)
        files.setdefault(row.package_id, {})[row.path] = row.content
    texts = {(p, k): text for p, k, _, text in data}
    for p, held in files.items():
        index = held.pop("context/index.md")
        chunks = [held[f"context/chunk-{k:03d}.md"] for k in range(1, len(held) + 1)]
        told = int(index.split("Token estimate: ")[1].split("\n")[0])
        exact = -(-len(index.encode()) // 4) + sum(-(-len(c.encode()) // 4) for c in chunks)
        assert exact <= told <= min(exact + 2, b.tokens)
        assert all(-(-len(c.encode()) // 4) <= b.chunk_tokens and c.startswith(b.header.format(k + 1)) for k, c in enumerate(chunks))
        assert index.count("](chunk-") == len(chunks)
        taken = [k for k in range(40) if (p, k) in texts and any(texts[p, k] in c for c in chunks)]
        assert f"Records in the context: {len(taken)}\n" in index
    assert len(files["a"]) > len(files["b"]) > 0 and files["c"] == {}


def test_repeated_places_are_rendered_once_each(spark):
    from pyspark.sql import functions as F

    sections = spark.createDataFrame([("a", 1, "r", "x\n")] * 3 + [("a", 1, "q", "y\n")], "package_id string, place int, record_id string, section string").withColumns({"size": F.lit(2).cast("long"), "total": F.lit(4).cast("long")})
    packages = spark.createDataFrame([("a", "d", "{}", "[]")], "package_id string, logical_digest string, capabilities string, losses string")
    got = {r.path: r.content for r in context.render(sections, packages).collect()}
    assert got["context/chunk-001.md"] == "# Context chunk 1\n\ny\nx\nx\nx\n"
    assert "Records in the context: 4\n" in got["context/index.md"]


def test_packages_stay_whole_where_a_join_is_turned_to_a_broadcast(spark):
    """A join by package planned as a merge and broadcast in the end reads its rows by writers, not by package."""
    from pyspark.sql import functions as F

    put = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in put.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 30000, 1, 6).select((F.col("id") % 5).cast("string").alias("package_id"), F.col("id").alias("place"), F.col("id").alias("record_id"), (F.col("id") * 37 % 900).alias("size"))
        totals = rows.groupBy("package_id").agg(F.count("*").alias("total"))
        b = context.Budget(tokens=3000, chunk_tokens=500)
        got = {(r.package_id, r.place): r.chunk for r in context.pack(rows.join(totals, "package_id"), b).collect()}
    finally:
        for k in put:
            spark.conf.unset(k)
    for p in range(5):
        packer = context.Packer(b, 6000)
        for k in range(p, 30000, 5):
            assert got[str(p), k] == packer.offer(k * 37 % 900), (p, k)


def test_sections_without_a_place_come_last(spark):
    rows = [("p", None, "last", 8000, 3), ("p", 1, "a", 8000, 3), ("p", 2, "b", 8000, 3)]
    got = {r.record_id: r.chunk for r in context.pack(spark.createDataFrame(rows, "package_id string, place long, record_id string, size long, total long"), context.Budget(tokens=4300)).collect()}
    assert got == {"a": 1, "b": 2, "last": None}
