import json

from millrace import cli


def test_files_to_answers(spark, tmp_path, capsys):
    (tmp_path / "raw" / "fujian").mkdir(parents=True)
    (tmp_path / "raw" / "fujian" / "a.txt").write_text("生猪贷款办法\n\n一、申请条件\n\n生猪养殖户可以申请贷款贴息，单户最高50万元，期限12个月。", encoding="utf-8")
    out = str(tmp_path / "out")

    def run(*args):
        assert cli.main(list(args)) == 0
        return json.loads(capsys.readouterr().out)

    assert run("ingest", str(tmp_path / "raw"), "--output", out)["total_files"] == 1
    chunks = ("--data-dir", out, "--chunk-path", "kb_chunks.jsonl")
    assert run("index", *chunks, "--output", f"{out}/index")["chunk_count"] == 2
    built, saved = run("ask", "生猪贷款贴息", *chunks), run("ask", "生猪贷款贴息", *chunks, "--index", f"{out}/index")
    assert built == saved and saved["parameters"]["loan_amount_upper_limit"] == 500000.0 and saved["parameters"]["loan_term_months"] == 12
    assert run("ask", "生猪贷款贴息", *chunks, "--region", "adbc")["scenario"] == "no_result"
    first = run("ask", "养猪借10万元", *chunks, "--session-id", "s", "--region", "fj")
    second = run("ask", "xyz", *chunks, "--session-id", "s")
    assert (first["turn"], second["turn"]) == (1, 2) and second["region"] == "fj" and second["crop_or_activity"] == "养猪"
