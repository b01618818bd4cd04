import json

from reqlens import cli

ALB = [
    'https 2024-08-08T09:00:01.000000Z app/lb/abc 10.0.0.1:4000 10.1.0.5:80 0.001 0.250 0.000 200 200 120 3400 '
    '"GET https://ex.com:443/api/users/42?x=1 HTTP/1.1" "curl/8" ECDHE-RSA-AES128-GCM-SHA256 TLSv1.2',
    'https 2024-08-08T09:00:02.000000Z app/lb/abc 10.0.0.2:4000 10.1.0.5:80 0.001 0.900 0.000 503 503 120 10 '
    '"GET https://ex.com:443/api/users/43 HTTP/1.1" "curl/8" ECDHE-RSA-AES128-GCM-SHA256 TLSv1.2',
]


def test_cli_commands(spark, tmp_path):
    log = tmp_path / "a.log"
    log.write_text("\n".join(ALB) + "\n")
    d = cli.main(["detect", str(log)], spark=spark)
    assert d["log_type"] == "ALB" and d["success_rates"]["alb"] == 1.0
    out = cli.main(["filter", str(log), "--format", "alb", "--status", "5xx", "--out", str(tmp_path / "f")],
                   spark=spark)
    rows = [json.loads(x) for p in (tmp_path / "f").glob("part-*") for x in p.read_text().splitlines()]
    assert len(rows) == 1 and rows[0]["elb_status_code"] == 503 and out["path"]
    secs = cli.main(["stats", str(log), "--format", "alb", "--out", str(tmp_path / "s")], spark=spark)
    assert set(secs) >= {"summary", "url_stats", "time_stats", "ip_stats"}
    pats = cli.main(["patterns", str(log), "--format", "alb", "--out", str(tmp_path / "p")], spark=spark)
    got = spark.read.json(pats["patterns"]).collect()       # query stripped before generalising
    assert [(r["pattern"], r["count"]) for r in got] == [("https://ex.com:443/api/users/*", 2)]
    cli.main(["pivot", str(log), "--format", "alb", "--row", "url", "--col", "status",
              "--status-groups", "2xx,5xx", "--out", str(tmp_path / "v")], spark=spark)
    assert spark.read.json(str(tmp_path / "v")).count() == 2
    cli.main(["series", str(log), "--format", "alb", "--kind", "processing_time", "--metric", "p95",
              "--interval", "1min", "--out", str(tmp_path / "t")], spark=spark)
    # one URL has a query string, so it generalises to its own pattern (…/*?*)
    assert sorted(r["label"] for r in spark.read.json(str(tmp_path / "t")).collect()) == [
        "https://ex.com:443/api/users/*", "https://ex.com:443/api/users/*?*"]
    cli.main(["export", str(log), "--format", "alb", "--sep", ";", "--out", str(tmp_path / "e")], spark=spark)
    assert spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "e")).count() == 2
    rules = tmp_path / "rules.txt"
    rules.write_text("https://ex.com:443/api/*\n")
    cli.main(["series", str(log), "--format", "alb", "--rules", str(rules), "--interval", "1min", "--time", "request_creation_time",
              "--out", str(tmp_path / "u")], spark=spark)
    assert {r["label"] for r in spark.read.json(str(tmp_path / "u")).collect()} <= {"https://ex.com:443/api/*"}
