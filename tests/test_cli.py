import json

from textloom.cli import main
from textloom.sources.reports import dashboard, script_safe


def put(folder, **files):
    folder.mkdir()
    for k, v in files.items():
        (folder / f"{k}.txt").write_bytes(v if isinstance(v, bytes) else v.encode())
    return str(folder)


def test_screening(spark, tmp_path, capsys):
    text = "海は青く広い。波は静かに寄せる。夜の浜辺は誰もいない。"
    src = put(tmp_path / "in", a=text, b=text, c="音楽は心を癒やす。", d=b"", e=b"\x81\x7f\x81\x7f")
    out = tmp_path / "out"
    args = [src, "--output-dir", str(out), "--json-file", str(tmp_path / "r.json"), "--spans"]
    assert main(args, spark) == 0
    got = json.loads((tmp_path / "r.json").read_text())
    assert {x["reason"] for x in got["skipped"]} == {"empty_input", "unreadable"}
    assert len(got["results"]) == 3 and got["results"][0]["signal"] == "RED"
    assert got["spans"]["a.txt_vs_b.txt"] == [{"a_start": 0, "a_end": len(text), "b_start": 0, "b_end": len(text)}]
    assert "RED: a.txt &lt;-&gt;" not in (out / "dashboard.html").read_text() and "RED: a.txt <-> b.txt" in (out / "dashboard.html").read_text()
    assert (out / "diff_htmls" / "a.txt_vs_b.txt.html").exists()
    assert main([src, "--output-dir", str(out), "--fail-on-risk", "--standalone"], spark) == 1
    assert (out / "standalone_dashboard.html").exists()


def test_audit_and_gates(spark, tmp_path, capsys):
    src = put(tmp_path / "in", a="All nodes sync.")
    assert main([src, "--audit", "--lang", "auto", "--output-dir", str(tmp_path / "o")], spark) == 0
    assert "UNVERIFIED REMAINING: 1" in capsys.readouterr().out
    assert main([src, "--fail-on-unverified", "--lang", "en", "--output-dir", str(tmp_path / "o")], spark) == 1
    (tmp_path / "tags.json").write_text("{")
    assert main([src, "--audit-tags", str(tmp_path / "tags.json"), "--lang", "en"], spark) == 2


def test_refusals(spark, tmp_path):
    src = put(tmp_path / "in", a="x y z", b="x y z")
    assert main([str(tmp_path / "none")], spark) == 2
    assert main([src, "--spans", "--exclude-quotes"], spark) == 2
    assert main([src, "--base", put(tmp_path / "base", a="x")], spark) == 2
    assert main([src, "--base", put(tmp_path / "bad", z=b"")], spark) == 2
    assert main([put(tmp_path / "one", a="x")], spark) == 2


def test_escapes():
    assert script_safe({"a": "</script>&\u2028"}) == '{"a": "\\u003c/script\\u003e\\u0026\\u2028"}'
    assert "NO_ALERTS" in dashboard([], [])
    assert "&lt;x&gt;" in dashboard([("<x>", "b")], [])
