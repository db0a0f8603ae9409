import pytest
from pyspark.sql import functions as F

from sessionlens.functions import text as t


def one(spark, make, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(make(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).head()["x"]


@pytest.mark.parametrize(
    ("make", "given", "want"),
    [
        (t.strip_token, "https://h.example/a/b?auth=1#x", "https://h.example/a/b"),
        (t.strip_token, None, ""),
        (t.owner_from_build_name, "ann.lee triggered from host", "ann.lee"),
        (t.owner_from_build_name, "two words triggered", ""),
        (t.exception_type, "Object.errorWithException failed", ""),
        (t.exception_type, "java.lang.IllegalStateException: x", "IllegalStateException"),
        (t.root_exception, "RuntimeException: a\nCaused by: b.c.IOError: d\nCaused by: e.SocketTimeout: f", "SocketTimeout"),
        (t.app_frame, "at org.junit.Run.go(Run.java:1)\n at com.gojek.pay.Cart.sum(Cart.java:2)", "Cart.sum"),
        (t.top_frame, "at org.junit.Run.go(Run.java:1)", "Run.go"),
        (t.mask, "id 'x' took 30ms at http://a.b/c {id=1} 0xAF line:12 1,234", "id STR took DUR at URL LOC HEX line LINE NUM"),
        (t.message_signature, "2026-08-05 04:51:22:421 - [ab][HTTP] a.b.FooError: button 12 missing", "button NUM missing"),
        (t.fingerprint, "FooError: got 3\n at com.gojek.A.b(A.java:1)", "FooError @ A.b"),
        (t.fingerprint, "FooError: got 3", "FooError: got NUM"),
        (t.fingerprint, "nothing here", ""),
        (t.cluster_label, "[ab] it broke\nmore", "it broke"),
        (t.cluster_label, "", "Unknown failure"),
        (t.split_camel, "testGoldHomeMFL2Top", "test Gold Home MFL2 Top"),
        (t.feature_area, "testGoldHome", "gold"),
        (t.feature_area, "pingOnly", "unmapped"),
        (t.feature_area, None, "unmapped"),
        (t.trim_delimiters, '"Balance (net)"', "Balance (net)"),
        (t.trim_delimiters, "Fund)]", "Fund"),
        (t.extract_locator, "By.chained({AppiumBy.accessibilityId: Pay now})", "Pay now"),
        (t.extract_locator, 'xpath //*[@content-desc=\\"Gold tab\\"]', "Gold tab"),
        (t.extract_locator, "id: 123456789012345", ""),
        (t.extract_selector, '{"selector": "//a[@b=\\"c\\"]"}', '//a[@b="c"]'),
        (t.extract_selector, "locating by this strategy: By.id(x)\nnext", "By.id(x)"),
        (t.extract_screen, "seen on HomeActivity now", "HomeActivity"),
        (t.extract_error, "setup\n[ADB] Getting focused\nX: AssertionError\nafter\n\nend", "X: AssertionError\nafter\nend"),
        (t.extract_error, "a\nb\nc\nd\ne\nf\ng", "b\nc\nd\ne\nf\ng"),
        (t.looks_like_crash, "no crash recorded for this one", False),
        (t.looks_like_crash, "FATAL EXCEPTION: main process", True),
        (t.looks_corrupted, "[HTTP] --> POST /session", True),
        (t.looks_corrupted, "[HTTP] FooError: x", False),
        (t.has_error, "could not open", True),
        (t.has_error, "COMPLETED", False),
    ],
)
def test_text(spark, make, given, want):
    assert one(spark, make, given) == want


@pytest.mark.parametrize(("p", "v", "want"), [("ios", "17.3", "iOS 17.3"), ("Android", "unknown", "Android"), (None, "9", "9"), ("tv", None, "unknown"), ("os x", "14", "macOS 14")])
def test_os_label(spark, p, v, want):
    assert one(spark, t.os_label, p, v) == want


def test_lines_follow_every_separator(spark):
    assert one(spark, t.lines, "a\x0bb\r\nc d\n") == ["a", "b", "c", "d"]
    assert one(spark, t.lines, "") == []
