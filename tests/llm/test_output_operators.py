import gzip
import hashlib
import math
import zlib

import numpy as np
import pytest
from doclens.llm import token_counts, token_output, warc
from doclens.llm.sharding import balanced_tree, shard_rows, weight
from doclens.llm.tokenizers import byte_model, byte_parts, piece_model, piece_parts, vocabulary
from doclens.session import shared_folder
from pyspark.sql import functions as F

BYTE = "byte_bpe_50k.tiktoken"
HARD = [
    "", "a b", "a  b", " a", "a ", "a  b", "a  b", "x  y", "a　b\n\nc\td", "é è", "é\n è ü\tß", "it's 'll we're",
    "a\x1c b", "日本 語 x", " \n ", "a\r\nb 1 2 3! ?", "\u0085 a \u0085b", "<|endoftext|> <s> </s>", "ab cd " * 4000, "x" * 9000,
]


def test_cut_texts_keep_their_tokens():
    piece, byte = piece_model(vocabulary("piece_bpe_32k.model")), byte_model(vocabulary(BYTE))
    for text in HARD + ["  ".join(["Ab", "c\n d", "é f"] * 3000)]:
        assert [i for p in piece_parts(text) for i in piece.encode(p)] == piece.encode(text)
        assert [i for p in byte_parts(text) for i in byte.encode_ordinary(p)] == byte.encode_ordinary(text)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", BYTE, "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts(spark, edge, name):
    rows = token_counts.token_counts(edge, name).collect()
    parts_of, count = token_counts.lengths(name, vocabulary(name))
    texts = {(r["doc_id"]): r["text"] or "" for r in edge.collect()}
    assert len(rows) == 12
    assert rows[0].asDict().keys() == {"doc_id", "source", "id", "size", "node", "n_bytes", "n_tokens", "over_limit"}
    for r in rows:
        n = count([texts[r["doc_id"]]])[0] if texts[r["doc_id"]] else 0
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)
    assert token_counts.token_counts(edge.limit(0), name).count() == 0


def test_batches_are_balanced_by_bytes():
    texts = ["word " * 900, "日本語 " * 900, "", "é ü ß " * 900, "the end of it " * 40_000] * 40
    batches = list(token_counts.byte_batches(texts, piece_parts))
    sizes = [[len(p.encode()) for p in parts] for parts, _ in batches]
    assert all(sum(s[:-1]) < token_counts.BATCH_BYTES for s in sizes) and all(sum(s) >= token_counts.BATCH_BYTES for s in sizes[:-1])
    assert max(map(sum, sizes)) < 1.5 * token_counts.BATCH_BYTES  # long texts are cut
    joined = [""] * len(texts)
    for parts, owners in batches:
        for part, i in zip(parts, owners):
            joined[i] += part
    # a blank at a cut may be left to the tokenizer, which puts one before every part
    assert [t.replace(" ", "") for t in joined] == [t.replace(" ", "") for t in texts]


def test_permutation_is_a_bijection():
    for size in (1, 2, 3, 16, 17, 1000, 65_537):
        order = token_output.Permutation(size, 7)
        slots = order.slots(np.arange(size))
        assert sorted(slots.tolist()) == list(range(size))
        assert (order.sequences(slots) == np.arange(size)).all()
    assert (token_output.Permutation(1000, 7).slots(np.arange(1000)) != token_output.Permutation(1000, 8).slots(np.arange(1000))).any()


def test_shards_hold_the_streams(spark, edge):
    folder = shared_folder(spark, "test-shards")
    pieces = token_output.write_training_order(edge, folder, length=64, per_shard=5)
    rows = pieces.collect()
    model = byte_model(vocabulary(BYTE))
    shards = sorted({(r["first_slot"], r["file"]) for r in rows})
    assert sorted({r["shard"] for r in rows}) == list(range(len(shards)))
    sequences = 1 + max(r["slot"] for r in rows)
    assert {r["slot"] for r in rows} == set(range(sequences))
    read = [x.tolist() for x in token_output.read_sequences(folder, shards, 0, sequences, 64)]
    assert [x.tolist() for x in token_output.read_sequences(folder, shards, 7, 9, 64)] == read[7:16]
    assert all(len(x) == 64 for x in read)
    texts = {r["doc_id"]: model.encode_ordinary(r["text"] or "") + [50256] for r in edge.collect()}
    held = {}
    filled = [0] * sequences
    for r in sorted(rows, key=lambda r: (r["slot"], r["position"])):
        assert r["position"] == filled[r["slot"]]
        filled[r["slot"]] += r["n_tokens"]
        own = read[r["slot"]][r["position"] : r["position"] + r["n_tokens"]]
        assert own == texts[r["id"]][r["first_token"] : r["first_token"] + r["n_tokens"]]
        held[r["id"]] = held.get(r["id"], 0) + r["n_tokens"]
    # every token is there, once for each row
    copies = {2: 2}
    assert held == {i: len(t) * copies.get(i, 1) for i, t in texts.items()}
    assert all(x[n:] == [50256] * (64 - n) for x, n in zip(read, filled))
    for r in token_output.read_pieces(pieces, folder, 64).collect():
        own = np.array(texts[r["id"]][r["first_token"] : r["first_token"] + r["n_tokens"]], "<u2")
        assert r["tokens_crc32"] == zlib.crc32(own.tobytes())
    assert token_output.training_order(edge.limit(0)).count() == 0


def test_order_is_fixed_by_the_key(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    place = lambda **o: {(r["doc_id"], r["first_token"]): r["slot"] for r in token_output.training_order(docs, length=128, **o).collect()}
    once = place()
    assert once == place() and once != place(key=7)
    # neighbours in the table lie apart in the order
    apart = [abs(once[i, 0] - once[i + 1, 0]) for i in range(150) if (i, 0) in once and (i + 1, 0) in once]
    assert sorted(apart)[len(apart) // 2] > 0.1 * len(set(once.values()))


def test_slots_are_the_permutation_of_the_stream_however_it_is_read(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").repartition(3).write.option("parquet.block.size", 65_536).parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    model = byte_model(vocabulary(BYTE))
    ordered = docs.select("doc_id", "text", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()
    stream = np.concatenate([[*model.encode_ordinary(r["text"] or ""), 50256] for r in ordered]).astype("<u2")
    n = -(-len(stream) // 128)
    stream = np.append(stream, np.full(n * 128 - len(stream), 50256)).astype("<u2").reshape(n, 128)
    slots = token_output.Permutation(n, 42).slots(np.arange(n))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size, rows in (("128m", docs), ("60k", docs), ("128m", docs.repartition(5))):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        folder = shared_folder(spark, "test-order")
        try:
            got = token_output.write_training_order(rows, folder, length=128, per_shard=40).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        shards = sorted({(r["first_slot"], r["file"]) for r in got})
        assert [s for s, _ in shards] == list(range(0, n, 40))
        read = np.array(list(token_output.read_sequences(folder, shards, 0, n, 128)))
        assert (read[slots] == stream).all()


def test_starts_of_many_files_are_looked_up_in_blocks(spark, sf, tmp_path, monkeypatch):
    spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60").repartition(9).write.parquet(str(tmp_path / "d"))
    scan = spark.read.parquet(str(tmp_path / "d"))
    model = byte_model(vocabulary(BYTE))
    for docs in (scan, scan.filter("doc_id % 3 > 0"), scan.unionAll(scan).repartition(3), scan.selectExpr("*", "explode(array(1, 2)) AS copy")):
        rows = docs.select("doc_id", "text").collect()
        want = sorted(tuple(model.encode_ordinary(r["text"] or "")) + (50256,) for r in rows)
        results = []
        for size in (2, 10_000):
            monkeypatch.setattr(token_output, "BLOCK_STRETCHES", size)
            folder = shared_folder(spark, "test-many")
            got = token_output.write_training_order(docs, folder, length=64, per_shard=40).collect()
            shards = sorted({(r["first_slot"], r["file"]) for r in got})
            n = 1 + max(r["slot"] for r in got)
            read = np.array(list(token_output.read_sequences(folder, shards, 0, n, 64)))
            stream = read[token_output.Permutation(n, 42).slots(np.arange(n))].ravel()
            ends = np.flatnonzero(stream == 50256)[: len(rows)] + 1
            results.append([tuple(x.tolist()) for x in np.split(stream, ends)[:-1]])
        assert sorted(results[0]) == want and results[0] == results[1]


def test_shards(spark, edge):
    rows = shard_rows(edge, balanced_tree(8), balanced_tree(9)).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in edge.collect()}
    assert len(rows) == 12
    for r in rows:
        assert (r["size"], r["text_crc32"], r["law"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]), "key")
        assert r["grown_shard"] in (r["shard"], 8)
    for shard in {r["shard"] for r in rows}:
        own = [r["slot"] for r in rows if r["shard"] == shard]
        assert sorted(own) == list(range(len(own)))
    assert shard_rows(edge.limit(0), balanced_tree(8)).count() == 0


def _place_by_hand(key, tree, path="root"):
    def draw(name, share):
        uniform = (int(hashlib.md5(f"{path}/{name}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(uniform) / share

    children = [(n, c) for n, c in tree.items() if weight(c) > 0]
    name, child = children[0] if len(children) == 1 else min(children, key=lambda x: draw(x[0], weight(x[1])))
    return _place_by_hand(key, child, f"{path}/{name}") if isinstance(child, dict) else name


def test_shards_and_slots_equal_a_plain_loop(spark, sf, edge):
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for docs in (documents, edge.select("doc_id", "text")):
        held = {}
        for r in docs.collect():
            key = "k" + ("" if r["doc_id"] is None else str(r["doc_id"])) + str(r["doc_id"] is None).lower()
            data = (r["text"] or "").encode()
            shard, more = _place_by_hand(key, balanced_tree(8)), _place_by_hand(key, balanced_tree(9))
            row = (hashlib.md5(key.encode()).hexdigest(), zlib.crc32(data), len(data) + 1, r["doc_id"], more)
            held.setdefault(shard, []).append(row)
        # equal rows tie in everything but the slot
        want = [
            (doc, size, crc, "key", shard, slot, more)
            for shard, rows in held.items()
            for slot, (_, crc, size, doc, more) in enumerate(sorted(rows, key=lambda x: x[:3]))
        ]
        got = [tuple(r) for r in shard_rows(docs, balanced_tree(8), balanced_tree(9)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_shares_follow_weights_and_movement_stays_in_the_changed_subtree(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    tree = {"a": {"r0": {0: 1.0, 1: 3.0}, "r1": {2: 2.0}}, "b": {"r2": {3: 2.0}}}
    changed = {"a": {"r0": {0: 1.0, 1: 5.0}, "r1": {2: 2.0}}, "b": {"r2": {3: 2.0}}}
    moved = shard_rows(docs, tree, changed).groupBy("shard", "grown_shard").count().collect()
    before = {s: sum(r["count"] for r in moved if r["shard"] == s) for s in range(4)}
    assert all(abs(before[s] / 20_000 - w / 8) < 0.015 for s, w in enumerate((1, 3, 2, 2)))
    # region b only loses; inside region a the rack that did not change only loses to the one that did
    assert not [r for r in moved if r["grown_shard"] == 3 and r["shard"] != 3]
    assert not [r for r in moved if r["shard"] in (0, 1) and r["grown_shard"] in (2, 3)]
    same = sum(r["count"] for r in moved if r["shard"] == r["grown_shard"])
    assert same > 15_000 and weight(tree) == 8.0
    assert shard_rows(docs, {"only": {"r": {5: 1.0}}}).filter("shard <> 5").count() == 0


PAGES = [
    (None, "http://a.b/", None, 1),
    (1, None, "x" * 2000, 1),
    (2, "HTTPS://U@Www.Ex.com:80/P?q=1#f", "x" * 2000, 1),
    (2, "http://www.ex.com/P?q=1", "x" * 2000, 1),
    (3, 'http://é.org/\n"x', "", 1),
    (4, "http://www.ex.com/P?q=1", "z" * 1000, 1),
    (5, "http://www.ex.com/P?q=1", "é" * 499 + "z", 1),
    (6, "http://www.ex.com/other", "é" * 499 + "z", 1),
    (7, "http://zz.com", "long " * 200_000, 1),
]


def test_archives(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, file int")
    _, directory, archives, index = warc.archive(pages)
    keys = pages.select(warc.url_key(F.col("url")).alias("key"))
    rows = warc.find_records(keys, directory, index, archives).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "") for r in rows) == sorted((p[0] or 0, p[1] or "") for p in PAGES)
    owners = {}
    for i, _, html, _ in PAGES:
        if i is not None and len((html or "").encode()) >= 1000:
            owners[html] = max(owners.get(html, 0), i)
    for r in rows:
        html = next(p[2] for p in PAGES if p[0] == r["page_id"]) or ""
        data = html.encode()
        revisit = html in owners and owners[html] != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert r["record_type"] == ("revisit" if revisit else "response")
        assert r["refers_to"] == (owners[html] if revisit else None)
        assert r["stored_bytes"] == (0 if revisit else len(data))
    sparse = [tuple(r)[:5] for r in directory.orderBy("first_key").collect()]
    found = warc.lookup(sparse, "com,ex,www)/p?q=1", index, archives)
    assert sorted(r["page_id"] for r in found) == [2, 2, 4, 5]
    assert warc.lookup(sparse, "com,ex,www)/p", index, archives) == []
    assert warc.lookup(sparse, ")/", index, archives)[0]["page_id"] == 1
    empty = warc.archive(pages.limit(0))
    assert warc.find_records(keys, empty[1], empty[3], empty[2]).count() == 0
    assert warc.find_records(keys.limit(0), directory, index, archives).count() == 0


@pytest.mark.parametrize("kind", ["bigint", "smallint", "string", "decimal(20,0)"])
def test_tables_of_keys_are_searched_through_many_blocks(spark, kind):
    urls = [f"http://h{i % 7}.ex/p{i % 90}" for i in range(300)] + ["http://hot.ex/"] * 150 + [None] * 20
    rows = [(i, u, f"page {i % 40} " * (1 + i % 200)) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("page_id", F.col("page_id").cast(kind)).repartition(5)
    _, directory, archives, index = warc.archive(pages, lines=2)
    assert directory.count() > 100 and directory.select("file").distinct().count() > 1
    key = warc.url_key(F.col("url")).alias("key")
    found = warc.find_records(pages.select(key), directory, index, archives, kind)
    assert found.schema["page_id"].dataType == pages.schema["page_id"].dataType == found.schema["refers_to"].dataType
    whole = pages.select("page_id", "url", key, F.sha1("html").alias("payload_digest"))
    columns = ["page_id", "url", "key", "payload_digest"]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))
    some = spark.createDataFrame([("ex,hot)/",), ("ex,hot)/",), ("ex,h3)/p3",), ("aa)/",), ("zz)/",), ("ex,h3)/p3x",), (None,)], "key string")
    got = warc.find_records(some, directory, index, archives, kind)
    want = whole.join(some.distinct(), "key")
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect())) and got.count() > 150


def test_payloads_read_back_are_compared_with_their_headers(spark, tmp_path):
    rows = warc.write_archives(spark.createDataFrame([(1, "http://a.b/", "payload" * 9)], "page_id long, url string, html string"), f"file://{tmp_path}/w").collect()
    data = (tmp_path / "w" / rows[0]["file"]).read_bytes()
    record = gzip.decompress(data[rows[0]["start"] : rows[0]["start"] + rows[0]["length"]])
    assert warc.parse_record(record)["payload"] == b"payload" * 9
    for damaged in (record.replace(b"payloadpay", b"payl0adpay"), record[:-8]):
        with pytest.raises(ValueError):
            warc.parse_record(damaged)


def test_archives_are_plain_members(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, file int").coalesce(1)
    rows = warc.write_archives(pages, f"file://{tmp_path}/w").collect()
    for name in {r["file"] for r in rows}:
        whole = gzip.decompress((tmp_path / "w" / name).read_bytes())
        assert whole.count(b"WARC/1.1\r\n") == len([r for r in rows if r["file"] == name])
