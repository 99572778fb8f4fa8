import pytest
from test_sources import MESSAGE, NODES, bag, store

from postlake.extract import Options, extract, inspect


def test_run_and_resume(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    contact = bag((0x001A, 0x001F, "IPM.Contact".encode("utf-16-le")), (0x0C1A, 0x001F, "Ann".encode("utf-16-le")), (0x1000, 0x001F, "A body".encode("utf-16-le")), (0x007D, 0x001E, b"From: a\r\n"))
    (src / "one.pst").write_bytes(store(NODES | {0x64: contact}, 1))
    (src / "two.pst").write_bytes(store({0x24: MESSAGE, 0x28: MESSAGE}, 2))
    (src / "bad.pst").write_bytes(b"nothing")
    got = extract(spark, str(src), out).first()
    assert (got.discovered, got.completed, got.partial, got.failed, got.not_run, got.batch_status) == (3, 1, 1, 1, 0, "completed_with_failures")
    read = lambda t: spark.read.parquet(f"{out}/{t}")
    m = {(r.path[-7:], r.message_node_id): r for r in read("messages").collect()}
    assert m["one.pst", "node_24"].routing_status == "routed_email" and m["one.pst", "node_64"].routing_status == "routed_contact" and m["two.pst", "node_28"].routing_status == "filtered_associated"
    assert m["one.pst", "node_44"].item_type == "message_candidate" and m["one.pst", "node_24"].message_key != m["two.pst", "node_24"].message_key
    assert [r.full_name for r in read("contacts").collect()] == ["Ann"] and [r.size_bytes for r in read("bodies").collect()] == [6]
    assert {r.status for r in read("headers").collect()} == {"transport_headers_valid", "transport_headers_absent"}
    assert sorted(r.folder_path for r in read("folders").where("path like '%one.pst'").collect()) == ["/", "/Inbox"]
    again = extract(spark, str(src), out).first()
    assert (again.skipped, again.failed) == (2, 1) and read("messages").count() == len(m)
    assert inspect(spark, str(src)).where("report like '%ready%'").count() == 2
    with pytest.raises(ValueError):
        Options(item_type="none")
