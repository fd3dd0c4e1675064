import json

from graphs import LEFT, RIGHT, document

from prismgraph.cli import main
from prismgraph.sources.builder import JSON


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "json.json").write_text(JSON.to_json())
    for world, docs in (("left", LEFT), ("right", RIGHT)):
        (tmp_path / f"{world}.jsonl").write_text("\n".join(document(n, x, world) for n, x in docs))
    run = lambda *args: (main(["--corpus", f"file://{tmp_path}/c", *args], spark), capsys.readouterr())
    assert run("add", "left", str(tmp_path / "left.jsonl"))[0] == 1  # no declaration
    assert run("add", "left", str(tmp_path / "left.jsonl"), "--declaration", str(tmp_path / "json.json"))[1].out == "3 units added\n"
    assert run("add", "right", str(tmp_path / "right.jsonl"))[0] == 0
    code, said = run("check", str(tmp_path / "left.jsonl"), str(tmp_path / "right.jsonl"))
    assert code == 0 and "6 units checked, 0 break" in said.out
    assert "json/1 structure+names+constants" in run("recipes")[1].out
    main(["--corpus", f"file://{tmp_path}/c", "--json", "bucket", "--unit", "document", "--facet", "names-blind"], spark)
    assert sorted(r["members"] for r in json.loads(capsys.readouterr().out)) == ["invoice", "ticket"]
    assert json.loads(run("root")[1].out)["rows"] == 12
    assert run("root", "--check", "00")[0] == 1
    assert len(run("claim", "same", "left::=profile", "right::=profile", "--unit", "document", "--facet", "names-blind", "--witness", "hand", "by=me")[1].out) == 65
    assert run("attest", "good", "left::=invoice", "--unit", "document", "--witness", "x", "bad")[0] == 1
    assert "claim" in run("assertions")[1].out
    assert json.loads(run("declaration", "print", "json/1")[1].out)["recipe"] == "json/1"
