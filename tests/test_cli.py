"""The command line on small files."""

import json

import pytest

from tests import fixtures as X
from tidemark import cli, sources


def test_verbs(spark, tmp_path, capsys):
    path = str(tmp_path / "t.ndjson")
    sources.write_ticks(X.rising_day(spark), path)
    for arguments, key in (
        (["summary", "--input", path], "bars"), (["vwap", "--input", path], "vwap"), (["pov-plan", "--input", path, "--cap", "0.5"], "pov_price"), (["eval", "--input", path], "algo"),
        (["stream", "--input", path], "rows"), (["schedule", "--coef-bps", "25"], "urgency"), (["synth-quotes", "--out", str(tmp_path / "q.ndjson"), "--n", "4"], "rows"), (["convert", "--input", path, "--out", str(tmp_path / "u.parquet")], "rows"),
    ):
        a = cli._parser().parse_args(arguments)
        out = cli.run(spark, a)
        assert out == 4 if isinstance(out, int) else key in json.loads(out.toJSON().first())


def test_captures_without_spark(tmp_path, capsys):
    (tmp_path / "feed").write_text(json.dumps({"type": "ticker", "product_id": "P", "time": "2024-07-01T00:00:01Z", "best_bid": "1", "best_bid_size": "2", "best_ask": "3", "best_ask_size": "4"}) + "\n")
    assert cli.main(["ingest-quotes", "--replay", str(tmp_path / "feed"), "--out", str(tmp_path / "q.ndjson")]) == 0
    assert json.loads((tmp_path / "q.ndjson").read_text())["ask"] == 3.0 and json.loads(capsys.readouterr().out) == {"rows": 1}


def test_refusals(spark, tmp_path):
    with pytest.raises(ValueError, match="NDJSON"):
        cli.run(spark, cli._parser().parse_args(["stream", "--input", "x.parquet"]))
