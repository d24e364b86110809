import pytest

from pactspark.functions import rules

CTX = {"tenant": "acme", "roles": ["admin"], "n": 7}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("ctx.tenant == 'acme' && 'admin' in ctx.roles", True),
        ("ctx.n % 2 == 1 ? 'odd' : 'even'", "odd"),
        ("has(ctx.missing)", False),
        ("ctx.missing == null", True),
        ("partial('0712345605', 4)", "***5605"),
        ("redact('x')", "***"),
        ("partial('abcd', 4)", "***"),
        ("'254712345678'.matches('^254')", True),
        ("!(1 + 2 * 3 > 7)", True),
    ],
)
def test_driver_values(text, expected):
    assert rules.Builder(CTX).build(rules.parse(text)) == expected


@pytest.mark.parametrize("text", ["1 +", "row.", "a b", "@", "(1", "nothing(1)", "row.x"])
def test_bad_rules_are_errors(text):
    with pytest.raises(rules.RuleError):
        rules.Builder(CTX).build(rules.parse(text))


def test_rows_and_driver_agree(spark):
    values = [("0712345605", 3), ("254712345678", 4), ("ab", None), (None, 0)]
    frame = spark.createDataFrame(values, "s string, n int")
    for text in ("hash_sha256(row.s)", "partial(row.s, 4)", "redact(row.s)", "is_msisdn(row.s)", "row.s.startsWith('07')", "row.n >= 3", "row.n + 1 == 5"):
        node = rules.parse(text)
        on_rows = [r[0] for r in frame.select(rules.Builder({}, {"s", "n"}).column(node)).collect()]
        plain = [rules.Builder({"s": s, "n": n}).build(rules.parse(text.replace("row.", "ctx."))) for s, n in values]
        assert on_rows == plain, text


def test_lists_of_rows(spark):
    frame = spark.createDataFrame([(["ke-nbo"],), (["ug-kla"],)], "tags array<string>")
    node = rules.parse("row.tags.exists(t, t.startsWith('ke'))")
    assert [r[0] for r in frame.select(rules.Builder({}, {"tags"}).column(node)).collect()] == [True, False]
