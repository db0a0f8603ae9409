import json
import random

import pytest
from pyspark.sql import functions as F

from sessionlens.operators import clusters, flakiness, graph, inference, metrics, profiling, risk, taxonomy

COLUMNS = "row_id long, session_id string, name string, status string, reason string, duration double, platform string, project string, os_version string, device string, app_version string, session_url string, created_at string, build_id string, log_text string, is_failure boolean, browserstack_seconds double, user_seconds double"


def sessions(spark, rows):
    out = []
    for i, r in enumerate(rows):
        base = dict(row_id=i, session_id=f"s{i}", name="n", status="passed", reason="", duration=10.0, platform="ios", project="p", os_version="17", device="d", app_version="1", session_url="", created_at=f"2026-01-01T00:{i % 60:02d}:00Z", build_id="b", log_text="", is_failure=False, browserstack_seconds=1.0, user_seconds=3.0)
        base.update(r)
        out.append(tuple(base[c.split()[0]] for c in COLUMNS.split(", ")))
    return spark.createDataFrame(out, COLUMNS)


def test_device_risk_ranks_proof_over_luck(spark):
    rows = [dict(device="once", is_failure=True)] + [dict(device="often", is_failure=k < 5) for k in range(10)] + [dict(device=None, is_failure=True)]
    got = risk.device_risk(risk.with_dimensions(sessions(spark, rows))).collect()
    assert [(r["device"], r["low_sample"]) for r in got] == [("often", False), ("once", True)]


def test_flips_between_builds(spark):
    rows = [dict(name="t", build_id=f"b{k}", created_at=f"2026-01-0{k + 1}", is_failure=k % 2 == 0) for k in range(4)]
    r = flakiness.across_builds(sessions(spark, rows)).head()
    assert (r["flip_rate"], r["builds"], r["mixed_rate"], r["low_sample"]) == (1.0, 4, 0.0, False)


def test_repeats_within_a_build_do_not_flip(spark):
    rows = [dict(name="t", is_failure=k % 2 == 0) for k in range(8)]
    r = flakiness.across_builds(sessions(spark, rows)).head()
    assert (r["flip_rate"], r["mixed_rate"], r["low_sample"]) == (0.0, 1.0, True)


def test_flakiness_needs_no_history(spark):
    s = sessions(spark, [dict(name="t", is_failure=k < 3) for k in range(6)])
    assert flakiness.flakiness_index(s, s.limit(0)).columns == flakiness.in_build(s).columns


@pytest.mark.parametrize(
    ("reason", "duration", "status", "want"),
    [
        ("FATAL EXCEPTION then NoSuchElementException", 90.0, "failed", "app-crash"),
        ("permissioncontroller: element not found", 90.0, "failed", "native-permission-dialog"),
        ("status code: 503", 90.0, "failed", "backend-error"),
        ("paid Rp 500 but a mismatch", 90.0, "failed", "assertion-failure"),
        ('expected: "x" but was: "y"', 10.0, "failed", "assertion-failure"),
        ("", 10.0, "failed", "test-did-not-run"),
        ("", 600.0, "failed", "no-diagnostic-logs"),
        ("SomethingOddError: x", 10.0, "timeout", "test-did-not-run"),
        ("WeirdException: x", 10.0, "timeout", "uncategorized"),
        (None, None, None, "no-diagnostic-logs"),
    ],
)
def test_taxonomy_order(spark, reason, duration, status, want):
    df = spark.createDataFrame([(reason, duration, status)], "r string, d double, s string")
    assert df.select(taxonomy.classify(F.col("r"), F.lit(""), F.col("d"), F.col("s")).alias("c")).head()["c"] == want


def test_few_patterns_are_run(spark):
    """Rules give what all their patterns give, and a text leaves few of them to run."""
    from sessionlens import fixed
    from sessionlens.functions.literals import LiteralIndex, required
    from sessionlens.functions.text import rx
    from sessionlens.plans.adapter import REASONS

    rules = taxonomy.default_rules()
    index = taxonomy.index_of(rules)
    patterns = list(index.needs)
    assert len(patterns) > 100 and sum(n is None for n in index.needs.values()) == 0
    assert required(r"expect(?:ed|ing)\b.{0,120}?but was") == {"but was"} and required(r"\d+") is None and required("(?<n>ab") is None
    texts = [*REASONS, "", "x" * 500, "TOKEN HAſ EXPIRED, inİtial sıgnal 11", "timeouttimeout", "Response code: 503 bad gateway", "status code 500", "SSLHandshakeException", "auth request failed"]
    rng = random.Random(2)
    texts += ["".join(rng.choice(["not ", "visible", "is ", "expected ", "to ", "be", "api ", "error ", "failure", "exp", "ect", "session ", "timed out", "(", "\n", "401", " "]) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = index.found(F.col("text"))
    cells = df.select("id", index.runs(found).alias("runs"), F.array(*(F.col("text").rlike(rx(p, "i")) for p in patterns)).alias("all"), F.array(*(index.may_match(found, [p]) for p in patterns)).alias("may")).collect()
    assert not [(texts[r["id"]], p) for r in cells for p, a, m in zip(patterns, r["all"], r["may"]) if a and not m]
    assert sum(r["runs"] for r in cells[: len(REASONS)]) < 0.04 * len(patterns) * len(REASONS)
    assert LiteralIndex([r"\d"]).words == [] and fixed.TAXONOMY


def test_hotspots_need_two_tests(spark):
    rows = [dict(is_failure=True, name=n, reason=f'accessibilityId: "{loc}"') for n, loc in [("a", "Pay"), ("b", "Pay"), ("a", "Pay"), ("a", "Other")]]
    got = taxonomy.locator_hotspots(taxonomy.classify_failures(sessions(spark, rows))).collect()
    assert [(r["locator"], r["failures"], r["tests_affected"], r["omitted"]) for r in got] == [("Pay", 3, 2, 1)]


def test_findings_collapse_confounds(spark):
    rows = [dict(device="bad" if k < 40 else f"ok{k % 3}", os_version="99" if k < 40 else "17", is_failure=k % 40 < 30 if k < 40 else k % 20 == 0) for k in range(200)]
    got = inference.significant_findings(risk.with_dimensions(sessions(spark, rows))).collect()
    assert len(got) == 1
    assert got[0]["dimension"] == "device" and got[0]["confounded_with"] == "os_label=iOS 99"


def test_better_levels_are_no_findings(spark):
    rows = [dict(device="good" if k < 50 else "other", is_failure=k >= 50 and k % 2 == 0) for k in range(100)]
    assert [r["level"] for r in inference.significant_findings(risk.with_dimensions(sessions(spark, rows))).collect()] == ["other"]


def test_outlier_with_equal_durations(spark):
    rows = [dict(name="t", duration=10.0)] * 10 + [dict(name="t", duration=600.0)] + [dict(name="u", duration=10.0 + k) for k in range(10)]
    got = inference.duration_outliers(sessions(spark, rows)).collect()
    assert [(r["name"], r["slowest_seconds"], r["ratio"]) for r in got] == [("t", 600.0, 60.0)]


@pytest.mark.parametrize("sketch", [1000, 1])
def test_group_medians_are_exact(spark, monkeypatch, sketch):
    """Hot, tied and tiny groups; with a sketch so coarse that it misses, too."""
    import statistics

    monkeypatch.setattr(inference, "SKETCH", sketch)
    rng = random.Random(9)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(5001)] + [("tied", float(rng.choice([1, 1, 1, 2]))) for _ in range(400)] + [("two", 1.0), ("two", 4.0), ("one", 3.0), (None, 1.0), ("one", None)]
    rows += [("steps", float(k // 100)) for k in range(1000)]
    df = spark.createDataFrame(rows, "name string, v double").repartition(7)
    got = {r["name"]: (r["n"], r["med"], r["top"]) for r in inference.group_medians(df, "name", "v").collect()}
    groups = {}
    for k, v in rows:
        if k and v is not None:
            groups.setdefault(k, []).append(v)
    assert got == {k: (len(v), pytest.approx(statistics.median(v)), max(v)) for k, v in groups.items()}
    assert set(r["name"] for r in inference.group_medians(df, "name", "v", 3).collect()) == {"hot", "tied", "steps"}


def test_group_medians_compute_their_sketch_once(spark):
    """A sketch differs with the order in which its parts come, so all that follows has to use one and the same."""
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "name string, v double")
    assert "percentile_approx" not in inference.group_medians(df, "name", "v")._jdf.queryExecution().toString()


def test_rank_test_with_a_small_side_is_exact(spark):
    v = [5.5, 7.25, 9.5, 100.75, 101.5] + [float(k) for k in range(25_000)]
    s = sessions(spark, [dict(is_failure=k < 5) for k in range(len(v))]).join(spark.createDataFrame(list(enumerate(v)), "row_id long, app_cpu_mean double"), "row_id")
    r = inference.performance_vs_failure(s, ("app_cpu_mean",)).head()
    from sessionlens.functions import stats

    assert r["failed_n"] == 5 and r["p_value"] == stats.mann_whitney_exact(r["u"], 5, 25_000) and r["p_value"] < 1e-4


def test_time_split(spark):
    r = inference.time_split(sessions(spark, [{}, {}])).head()
    assert (r["browserstack_pct"], r["user_pct"]) == (25.0, 75.0)
    assert inference.time_split(sessions(spark, [dict(browserstack_seconds=0.0, user_seconds=None)])).count() == 0


def test_category_table_corrects_two_by_two(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 2 + [("b", "x")] * 3 + [("b", "y")] * 15
    got = inference.category_by_dimension(spark.createDataFrame(rows, "category string, os_label string")).collect()
    want = sum((abs(o - e) - 0.5) ** 2 / e for o, e in [(10, 5.2), (2, 6.8), (3, 7.8), (15, 10.2)])
    assert got[0]["chi2"] == pytest.approx(want) and got[0]["residual"] == round((10 - 5.2) / 5.2**0.5, 2)


def test_rank_test(spark):
    random.seed(3)
    rows = [dict(is_failure=k < 20) for k in range(60)]
    v = [random.gauss(3 if k < 20 else 0, 1) for k in range(60)]
    s = sessions(spark, rows).join(spark.createDataFrame(list(enumerate(v)), "row_id long, app_cpu_mean double"), "row_id")
    r = inference.performance_vs_failure(s, ("app_cpu_mean",)).head()
    u = sum((a > b) + 0.5 * (a == b) for a in v[:20] for b in v[20:])
    assert r["u"] == u and r["significant"] and r["effect"] == round(2 * u / 800 - 1, 2)
    assert inference.performance_vs_failure(s.where("row_id >= 17"), ("app_cpu_mean",)).count() == 0


def test_noise_shares_one_cluster(spark):
    noise = [dict(is_failure=True, reason=f"2026-08-05 04:51:22 - [a{k}][HTTP] Proxying [POST /x{k}]") for k in range(12)]
    real = [dict(is_failure=True, reason=f"java.lang.FooException: n {k}\n at com.gojek.A.b(A.java:{k})") for k in range(3)]
    groups, failures = clusters.cluster_failures(sessions(spark, [*noise, *real, dict(is_failure=True)]))
    got = [(r["size"], r["exception_type"]) for r in groups.collect()]
    assert got == [(12, ""), (3, "FooException")] and failures.count() == 15


def test_similar_texts_join(spark):
    texts = ["Savings icon is not visible on the landing page", "Savings icon is not visible on the landing screen", "could not open wallet menu", "Savings icon is not visible on the landing page"]
    groups, _ = clusters.cluster_failures(sessions(spark, [dict(is_failure=True, reason=x) for x in texts]))
    got = groups.collect()
    assert [r["size"] for r in got] == [3, 1] and 0.45 < got[0]["confidence"] < 1 and got[1]["confidence"] == 1.0


@pytest.mark.parametrize("least", [2, 3, 4])
def test_density_clusters_match_brute_force(spark, least):
    rng = random.Random(8)
    words = "savings icon wallet menu toggle page screen visible landing header".split()
    texts = {k: " ".join(rng.choice(words) for _ in range(4)) for k in range(30)}
    rows = [(k, x, 1 + k % 3 // 2) for k, x in texts.items()]
    df = spark.createDataFrame(rows, "id long, text string, m long")
    w = {}
    for r in clusters.term_weights(df).collect():
        w.setdefault(r["id"], {})[r["term"]] = r["w"]
    near = lambda a, b: sum(v * w[b].get(t, 0) for t, v in w[a].items()) >= 0.7 - 1e-12
    around = {a: [b for b in texts if b != a and near(a, b)] for a in texts}
    m = {k: n for k, _, n in rows}
    core = {a for a in texts if m[a] + sum(m[b] for b in around[a]) >= least}
    comp = {a: a for a in core}
    for _ in texts:
        for a in core:
            comp[a] = min([comp[a], *(comp[b] for b in around[a] if b in core)])
    want = {a: comp.get(a, min((comp[b] for b in around[a] if b in core), default=None)) for a in texts}
    got = {r["id"]: None if r["noise"] else r["comp"] for r in clusters.text_components(df, clusters.term_weights(df), 0.3, least).collect()}
    assert got == want and (least == 2 or None in want.values())


def test_weights_come_from_all_failures(spark):
    """Two texts that are alike only if the words of failures with a fingerprint count too, and the other way round."""
    loose = ["savings icon is not visible", "wallet banner is not visible"]
    traces = [f"java.lang.FooException: balance {'abcdefghij'[k % 10] * (k // 10 + 2)} refused\n\tat com.gojek.Wallet.open(Wallet.java:{k})" for k in range(200)]
    groups, _ = clusters.cluster_failures(sessions(spark, [dict(is_failure=True, reason=x) for x in loose + traces]))
    assert sorted(r["size"] for r in groups.collect()) == [2, 200]
    same = [f"java.lang.FooException: {'xyz'[k % 3]} icon is not visible\n\tat com.gojek.Wallet.open(Wallet.java:{k})" for k in range(200)]
    texts = ["savings icon is not visible", "wallet icon is not visible"]
    alone, _ = clusters.cluster_failures(sessions(spark, [dict(is_failure=True, reason=x) for x in texts]))
    among, _ = clusters.cluster_failures(sessions(spark, [dict(is_failure=True, reason=x) for x in texts + same]))
    assert [r["size"] for r in alone.collect()] == [2] and sorted(r["size"] for r in among.collect()) == [1, 1, 200]


def _boilerplate(n, seed=3):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(4))
    return [f"{name()} {name()} {name()} {name()} was not visible before the wait ended in the main window" for _ in range(n)]


def test_similar_texts_match_brute_force(spark, monkeypatch):
    texts = _boilerplate(600)
    texts += [" ".join([*x.split()[:3], "zzzz", *x.split()[4:]]) for x in texts[:40]] + ["wait ended"] * 0
    w = clusters.term_weights(spark.createDataFrame([(k, x, 1) for k, x in enumerate(texts)], "id long, text string, m long")).cache()
    vectors = {}
    for r in w.collect():
        vectors.setdefault(r["id"], {})[r["term"]] = r["w"]
    for least in (0.45, 0.2):
        want = {(a, b) for a in vectors for b in vectors if a < b and sum(v * vectors[b].get(t, 0) for t, v in vectors[a].items()) >= least - 1e-12}
        for block in (1000, 7):
            monkeypatch.setattr(clusters, "BLOCK", block)
            assert {tuple(r) for r in clusters.similar_texts(w, least).collect()} == want
        assert len(want) >= 40


def test_a_line_that_all_texts_share_makes_no_pairs(spark):
    """Candidates follow the links, not the square of the texts with the line."""
    n = 5000
    texts = _boilerplate(n)
    texts += [" ".join([*x.split()[:3], "zzzz", *x.split()[4:]]) for x in texts[:100]]
    w = clusters.term_weights(spark.createDataFrame([(k, x, 1) for k, x in enumerate(texts)], "id long, text string, m long")).cache()
    index = clusters.heads(w, 0.45)
    links = clusters.similar_texts(w, 0.45).count()
    candidates = clusters.candidate_pairs(index, 0.45).count()
    assert 100 <= links <= candidates < 20 * n


def test_cluster_rows_are_bounded_and_members_whole(spark, tmp_path):
    rows = [dict(is_failure=True, reason="java.lang.FooException: x", session_url="" if k % 2 else f"u{k:04d}") for k in range(300)] + [dict(is_failure=True, reason="BarError: y")]
    groups, failures = clusters.cluster_failures(sessions(spark, rows), examples=5)
    first = groups.head()
    assert (first["size"], len(first["session_ids"]), first["session_urls"]) == (300, 5, [f"u{k:04d}" for k in range(0, 10, 2)])
    every, _ = clusters.cluster_failures(sessions(spark, rows), examples=None)
    assert len(every.head()["session_ids"]) == 300 and every.head()["session_ids"][:5] == first["session_ids"]
    clusters.write_members(failures, str(tmp_path / "members"))
    back = spark.read.parquet(str(tmp_path / "members"))
    assert back.count() == 301 and clusters.cluster_sessions(back, [first["cluster_id"]]).count() == 300


def test_cluster_category_ties_go_to_the_first(spark):
    f = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "cluster_id int, session_id string, row_id long")
    c = spark.createDataFrame([("a", "x", "o"), ("b", "y", "o")], "session_id string, category string, owner string")
    assert clusters.label_clusters(f, c).head()["category"] == "x"


def test_components_match_a_search(spark):
    random.seed(5)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    got = {r["id"]: r["comp"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[start] == min(seen)


def test_metrics(spark):
    s = risk.with_dimensions(sessions(spark, [dict(is_failure=k < 3, reason="FooError: x" if k < 2 else "") for k in range(10)]))
    m = metrics.exec_metrics(s, clusters.cluster_failures(s)[0], risk.device_risk(s))
    r = metrics.summary_cards(m).head()
    assert (r["total_tests"], r["failed"], r["num_root_causes"], r["mttr_hours_saved"]) == (10, 3, 1, 0.4)


def test_comparability(spark):
    rows = [dict(platform="ios", app_version="1", created_at="2026-01-01T00:00:00Z"), dict(platform="android", app_version="2", created_at="2026-01-09T12:00:00Z")]
    r = risk.platform_comparability(sessions(spark, rows)).head()
    assert not r["comparable"] and "runs 8 days apart" in r["reasons"] and "ios is 8 days behind (last ran 2026-01-01)" in r["stale"]
    assert risk.platform_comparability(sessions(spark, rows[:1])).head()["comparable"]


def test_profile_figures(spark):
    points = [{"ts": float(k * 10), "cpu": 10.0 + k, "mem": 4000.0, "mema": 1000.0 if k % 2 else None, "batt": 90.0 - k, "temp": 30.0 + k, "app_cpu": float(k) if k < 6 else None, "app_mem": 100.0 + 50 * k} for k in range(8)]
    df = spark.createDataFrame([("a", json.dumps(points)), ("b", "[]"), ("c", None)], "session_id string, series string")
    got = {r["session_id"]: r for r in profiling.parse_profiles(df).collect()}
    a = got["a"]
    assert (a["profile_samples"], a["profile_seconds"], a["app_cpu_samples"], a["battery_delta_pct"], a["temp_delta_c"]) == (8, 70.0, 6, 7.0, 7.0)
    assert a["app_mem_growth_mb_per_min"] == 300.0 and a["device_mem_used_max_mb"] == 3000.0 and a["app_cpu_p95"] == 4.8
    assert got["b"]["profile_samples"] is None and got["c"]["profile_samples"] is None


def test_means_that_end_in_a_half(spark):
    """Means of hundredths whose fractions decide the rounding, in any order; infinite ones stay so."""
    from decimal import ROUND_HALF_UP, Decimal

    rng, rows, want = random.Random(5), [], {}
    for i in range(150):
        n = rng.choice([20, 50, 426, 1000])
        cents = [rng.randrange(20_000) for _ in range(n)]
        more = (5 * n - sum(cents)) % (10 * n)  # to a mean of some tenths and five hundredths
        cents = [c + more // n + (k < more % n) for k, c in enumerate(cents)]
        want[f"{i}"] = float((Decimal(sum(cents)) / n / 100).quantize(Decimal("0.1"), ROUND_HALF_UP))
        rows.append((f"{i}", json.dumps([{"cpu": c / 100} for c in cents])))
    rows.append(("inf", '[{"cpu": "Infinity"}, {"cpu": 1.0}]'))
    df = spark.createDataFrame(rows, "session_id string, series string")
    assert {r["session_id"]: r["device_cpu_mean"] for r in profiling.parse_profiles(df).collect()} == want | {"inf": float("inf")}


def test_means_of_doubles_are_added_up_in_blocks(spark):
    """As SQL's avg adds up doubles: in their order, by partial sums; neither as decimals nor in one long sum."""
    from decimal import ROUND_HALF_UP, Decimal

    def total(v):
        t = 0.0
        for x in v:
            t += x
        return t

    tenths = lambda x: float(x.quantize(Decimal("0.1"), ROUND_HALF_UP))
    rng, rows, want, long, decimals = random.Random(6), [("none", '[{"batt": 1.0}]')], {}, {}, {}
    for i in range(60):
        n = rng.choice([324, 1000, 1001, 4260])
        cents = [rng.randrange(20_000) for _ in range(n)]
        more = (5 * n - sum(cents)) % (10 * n)  # to a mean of some tenths and five hundredths
        v = [(c + more // n + (k < more % n)) / 100 for k, c in enumerate(cents)]
        blocks = total(total(v[k : k + profiling.BLOCK]) for k in range(0, n, profiling.BLOCK))
        want[f"{i}"], long[f"{i}"] = tenths(Decimal(repr(blocks / n))), tenths(Decimal(repr(total(v) / n)))
        decimals[f"{i}"] = tenths(sum(map(Decimal, map(repr, v))) / n)
        rows.append((f"{i}", json.dumps([{"cpu": x} for x in v])))
    assert want != long and want != decimals
    df = spark.createDataFrame(rows, "session_id string, series string")
    assert {r["session_id"]: r["device_cpu_mean"] for r in profiling.parse_profiles(df, exact=False).collect()} == want | {"none": None}
    assert {r["session_id"]: r["device_cpu_mean"] for r in profiling.parse_profiles(df).collect()} == decimals | {"none": None}


def test_results_do_not_depend_on_partitions(spark):
    rows = [dict(name=f"t{k % 5}", device=f"d{k % 3}", is_failure=k % 4 == 0, duration=float(k)) for k in range(120)]
    s = risk.with_dimensions(sessions(spark, rows))
    for f in (risk.device_risk, flakiness.in_build, risk.area_health):
        assert f(s).collect() == f(s.repartition(7)).collect()
