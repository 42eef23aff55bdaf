import struct

import pytest
from pyspark.sql import functions as F

from flowlens.operators import decode
from flowlens.plans import training
from flowlens.sources import corpus, models, packets, tables


def frame(proto, l4, ihl=5, ether=0x0800):
    eth = bytes.fromhex("0a0b0c0d0e0f" "010203040506") + struct.pack("!H", ether)
    ip = struct.pack("!BBHHHBBH4s4s", 0x40 | ihl, 0, 0, 0, 0, 64, proto, 0,
                     bytes([10, 0, 0, 1]), bytes([192, 168, 1, 255])) + b"\x01" * (ihl - 5) * 4
    return eth + ip + l4


TCP = struct.pack("!HHLLBBHHH", 40000, 443, 4294967295, 7, 6 << 4, 0x12, 0, 0, 0) + b"\x01" * 4
UDP = struct.pack("!HHHH", 53, 65535, 13, 0)


@pytest.fixture(scope="module")
def decoded(spark):
    data = {
        "short": b"\x01" * 10,
        "arp": frame(6, TCP, ether=0x0806),
        "tcp": frame(6, TCP + b"hello"),
        "options": frame(6, TCP + b"x", ihl=6),
        "udp": frame(17, UDP + b"abc"),
        "icmp": frame(1, b"\x08\x00"),
        "cut": frame(6, TCP[:19]),
        "cut_ip": frame(6, b"")[:30],
        "empty": frame(17, UDP),
    }
    df = spark.createDataFrame(list(data.items()), "name string, data binary")
    return {r["name"]: r for r in decode.decode_frames(df).collect()}


def test_ethernet(decoded):
    assert decoded["short"]["eth_type"] is None and decoded["short"]["eth_src_mac"] is None
    assert decoded["arp"]["eth_type"] == 0x0806 and decoded["arp"]["src_ip"] is None
    assert decoded["tcp"]["eth_src_mac"] == "01:02:03:04:05:06"
    assert decoded["tcp"]["eth_dst_mac"] == "0a:0b:0c:0d:0e:0f"


def test_ip(decoded):
    row = decoded["icmp"]
    assert (row["ip_version"], row["ip_protocol"], row["dst_ip"]) == (4, 1, "192.168.1.255")
    assert row["protocol"] is None and row["src_port"] is None and row["payload"] is None
    assert decoded["cut_ip"]["eth_type"] == 0x0800 and decoded["cut_ip"]["src_ip"] is None


@pytest.mark.parametrize("name, payload", [("tcp", b"hello"), ("options", b"x")])
def test_tcp(decoded, name, payload):
    row = decoded[name]
    assert (row["src_port"], row["dst_port"]) == (40000, 443)
    assert (row["tcp_seq"], row["tcp_ack"], row["tcp_flags"]) == (4294967295, 7, 0x12)
    assert row["tcp_syn"] and row["tcp_ack_flag"] and not row["tcp_fin"] and not row["tcp_urg"]
    assert bytes(row["payload"]) == payload and row["payload_length"] == len(payload)
    assert row["protocol"] == "tcp" and row["length"] == len(row["data"])


def test_udp_and_cut_frames(decoded):
    row = decoded["udp"]
    assert (row["src_port"], row["dst_port"], row["udp_length"]) == (53, 65535, 13)
    assert bytes(row["payload"]) == b"abc" and row["tcp_flags"] is None
    assert decoded["empty"]["payload_length"] == 0
    cut = decoded["cut"]
    assert cut["src_ip"] == "10.0.0.1" and cut["src_port"] is None and cut["protocol"] is None


def test_raw_ip(spark):
    df = spark.createDataFrame([(frame(17, UDP)[14:],)], "data binary")
    assert decode.decode_frames(df, "raw_ip").first()["dst_port"] == 65535
    with pytest.raises(ValueError):
        decode.decode_frames(df, "token_ring")


LABELLED = """src_ip,dst_ip,protocol,src_port,dst_port,length,label
192.168.1.1,192.168.1.2,tcp,12345,80,100,normal
192.168.1.2,192.168.1.3,udp,54321,53,200,attack
192.168.1.3,192.168.1.4,tcp,12345,80,100,normal
192.168.1.4,192.168.1.5,udp,54321,53,200,attack
192.168.1.5,192.168.1.6,tcp,12345,80,100,normal
192.168.1.6,192.168.1.7,udp,54321,53,200,attack
"""


def test_csv_corpus(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,z\n3,w\n4,v\n")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "notes.txt").write_text("x,y\n9,9\n")
    df, skipped = corpus.read_csv_corpus(spark, str(tmp_path))
    assert [(r["path"].rsplit("/", 1)[1], r["reason"]) for r in skipped.collect()] == [("c.csv", "no header")]
    rows = sorted((r["x"], r["y"], r["z"]) for r in df.na.fill(0).na.fill("").collect())
    assert rows == [(0, 3, "w"), (0, 4, "v"), (1, 2, "")]
    given, _ = corpus.read_csv_corpus(spark, str(tmp_path), {"x,y": "x string, y int"})
    assert dict(given.dtypes)["x"] == "string"
    with pytest.raises(ValueError):
        (tmp_path / "none").mkdir()
        corpus.read_csv_corpus(spark, str(tmp_path / "none"))


def test_csv_files_that_cannot_be_used(spark, tmp_path):
    (tmp_path / "a b%20.csv").write_text("x,y\r\n1,2\r\n")
    (tmp_path / "blank.csv").write_text("  \n1,2\n")
    (tmp_path / "bytes.csv").write_bytes(b"\xff\xfe,y\n1,2\n")
    (tmp_path / "long.csv").write_text("x" * (corpus.HEADER_BYTES + 5))
    (tmp_path / "wide.csv").write_text(",".join(f"c{i}" for i in range(9_000)))  # more than one chunk, no rows
    found = {r["path"].rsplit("/", 1)[1]: r for r in corpus.csv_headers(spark, str(tmp_path)).collect()}
    assert found["a b%20.csv"]["header"] == "x,y" and found["a b%20.csv"]["reason"] is None
    assert found["wide.csv"]["header"].endswith(",c8999")
    assert "longer" in found["long.csv"]["reason"] and found["blank.csv"]["reason"] == "no header"
    assert "utf-8" in found["bytes.csv"]["reason"]
    with pytest.raises(ValueError, match="no CSV files"):
        corpus.read_csv_corpus(spark, str(tmp_path / "absent"))


def test_broken_csv_rows_are_reported(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3\n4,5,6\n7,\n")
    (tmp_path / "b.csv").write_text("y,z\n8,w\n")
    df, skipped = corpus.read_csv_corpus(spark, str(tmp_path), broken="bad")
    assert skipped.count() == 0
    rows = {(r["x"], r["y"], r["z"], r["bad"]) for r in df.collect()}
    assert rows == {(1, 2, None, None), (3, None, None, "3"), (4, 5, None, "4,5,6"), (7, None, None, None), (None, 8, "w", None)}
    typed, _ = corpus.read_csv_corpus(spark, str(tmp_path), {"y,z": "y int, z int"}, broken="bad")
    assert [(r["y"], r["z"], r["bad"]) for r in typed.where("y = 8").collect()] == [(8, None, "8,w")]
    with pytest.raises(ValueError, match="column x"):
        corpus.read_csv_corpus(spark, str(tmp_path), broken="x")


def test_many_files_with_many_headers(spark, tmp_path):
    for i in range(600):
        (tmp_path / f"{i}.csv").write_text(f"id,c{i % 12}\n{i},{i * 2}\n")
    (tmp_path / "empty.csv").write_text("")
    schemas = {f"id,c{i}": f"id int, c{i} int" for i in range(12)}
    df, skipped = corpus.read_csv_corpus(spark, str(tmp_path), schemas)
    got = {r["id"]: [v for k, v in r.asDict().items() if k != "id" and v is not None] for r in df.collect()}
    assert got == {i: [i * 2] for i in range(600)} and skipped.count() == 1


def test_training_on_the_small_corpus(spark, tmp_path):
    for i in range(10):
        (tmp_path / f"{i}.csv").write_text(LABELLED)
    df, _ = corpus.read_csv_corpus(spark, str(tmp_path))
    prepared = training.prepare(df)
    assert len(prepared.features) == 6 and prepared.rows.count() == 60
    trained = training.train(prepared, trees=[3], depths=[2], folds=2)
    assert trained.metrics.first()["accuracy"] == 1.0  # the protocol tells the label
    folder = str(tmp_path / "models")
    models.save_model(trained.model, folder, "RandomForest")
    (tmp_path / "models" / "broken").mkdir()
    loaded, known, failed = models.load_models(spark, folder)
    assert list(loaded) == ["RandomForest"] and failed == ["broken"]
    assert known.first()["weight"] == 1.0
    assert models.load_models(spark, str(tmp_path / "no such folder"))[0] == {}


def test_training_needs_two_classes(spark):
    df = spark.createDataFrame([(1, "normal"), (2, "normal")], "x int, label string")
    with pytest.raises(ValueError):
        training.prepare(df)


def test_packet_files(spark, tmp_path):
    row = [(1, "2024-01-01 00:00:00.000001", b"raw", 100, "192.168.1.1")]
    df = spark.createDataFrame(row, "packet_id bigint, t string, data binary, length int, src_ip string")
    df = df.withColumn("timestamp", F.col("t").cast("timestamp")).drop("t")
    packets.write_packets(df, f"{tmp_path}/p")
    back = packets.read_packets(spark, f"{tmp_path}/p").first()
    assert back["data"] is None and back["src_ip"] == "192.168.1.1"
    assert back["timestamp"].microsecond == 1
    (tmp_path / "list.json").write_text('[{"packet_id": 1},\n {"packet_id": 2}]')
    listed = packets.read_packets(spark, f"{tmp_path}/list.json", multi_line=True)
    assert listed.count() == 2


def test_feedback_store(spark, tmp_path):
    schema = ("model_name string, packet_id bigint, timestamp double, features array<double>, "
              "prediction string, actual string, confidence double")  # fmt: skip
    rows = [(m, i, 1.0, [1.0], "normal", "attack", 0.5) for m in "ab" for i in range(3)]
    df = spark.createDataFrame(rows, schema)
    path = f"{tmp_path}/f"
    assert tables.write_feedback(df, path) and not tables.write_feedback(df.limit(0), path)
    tables.write_feedback(df.where("model_name = 'a'").limit(1), path, mode="replace")
    assert tables.read_feedback(spark, path, "a").count() == 1
    assert tables.read_feedback(spark, path, "b").count() == 3
    assert tables.clear_feedback(spark, path, "b") and not tables.clear_feedback(spark, path, "b")
    assert tables.read_feedback(spark, path).count() == 1


def test_failed_improvement_keeps_the_model(spark, tmp_path):
    from flowlens.plans.retraining import improve_model

    done = improve_model(spark, "a", f"{tmp_path}/nothing", f"{tmp_path}/m", current="old")
    assert done.model == "old" and not done.improved and done.reason
