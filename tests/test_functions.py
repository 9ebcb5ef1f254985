import pytest
from pyspark.sql import functions as F

from tarnflow.functions.masks import detect_format
from tarnflow.functions.regex import java_pattern, java_replacement
from tarnflow.operators import anonymize as A

#: Inputs and outputs of the operators.
VECTORS = [
    ("mask_email", {}, "john.smith@example.com", "jo******th@example.com"),
    ("mask_email", {}, "ab@test.com", "**@test.com"),
    ("mask_email", {}, "alice@example.com", "*****@example.com"),
    ("mask_email", {}, "notanemail", "***@***.com"),
    ("mask_email", {}, "", "***@***.com"),
    ("mask_email", {"keep_domain": False}, "john.smith@example.com", "jo******th@***********"),
    ("mask_phone", {}, "+1 (555) 123-4567", "+* (***) ***-4567"),
    ("mask_phone", {}, "123", "***"),
    ("mask_phone", {}, "", "***-****"),
    ("mask_credit_card", {}, "4242 4242 4242 4242", "**** **** **** 4242"),
    ("mask_ssn", {}, "123-45-6789", "***-**-6789"),
    ("mask_sin", {}, "123-456-789", "***-***-789"),
    ("mask_sin", {}, "123 456 789", "*** *** 789"),
    ("mask_tin", {}, "123456789RC0001", "*********RC0001"),
    ("mask_tin", {}, "12345-6789", "*****-6789"),
    ("mask_ip_address", {}, "192.168.1.1", "192.***.*.1"),
    ("mask_ip", {}, "not.an.ip", "***.***.***.***"),
    ("mask_iban", {}, "GB82WEST12345698765432", "GB" + "*" * 16 + "5432"),
    ("mask_person", {}, "John  Smith", "J*** S****"),
    ("mask_person", {}, "A", "A*"),
    ("mask_location", {}, "123 Main Street", "123 Mai* Str***"),
    ("mask_us_bank", {}, "Routing: 123456789, Account: 9876543210", "Routing: *****6789, Account: ******3210"),
    ("mask_ca_bank_account", {}, "12345-678-9012345", "*2345-678-***2345"),
    ("smart_mask", {}, "192.168.1.1", "192.***.*.1"),
    ("smart_mask", {"keep_first": 2, "keep_last": 0}, "abcdef", "ab****"),
    ("smart_mask", {"entity_type": "PERSON"}, "John Smith", "J*** S****"),
    ("redact", {}, "x", ""),
    ("replace", {"new_value": "n"}, "x", "n"),
    ("keep", {}, "x", "x"),
    ("mask", {}, "abc", "***"),
    ("mask", {"masking_char": "#", "chars_to_mask": 2}, "abcd", "##cd"),
]


def test_vectors(spark):
    df = spark.createDataFrame([(i, v[2]) for i, v in enumerate(VECTORS)], "i int, v string")
    cols = [A.operator(n, p)(F.col("v")).alias(f"c{i}") for i, (n, p, *_) in enumerate(VECTORS)]
    for i, row in enumerate(df.orderBy("i").select(*cols).collect()):
        assert row[i] == VECTORS[i][3], VECTORS[i]


def test_formats(spark):
    kinds = {"a@b.co": "EMAIL_ADDRESS", " 1.2.3.4 ": "IP_ADDRESS", "123456789": "US_SSN", "4242-4242-4242-4242": "CREDIT_CARD", "555-123-4567": "PHONE_NUMBER", "GB82WESTABCDEFGHIJ": "IBAN_CODE", "GB82WEST12345698765432": "CREDIT_CARD", "hello": "GENERIC"}
    rows = spark.createDataFrame([(k,) for k in kinds], "v string").select("v", detect_format(F.col("v"))).collect()
    assert {r[0]: r[1] for r in rows} == kinds


def test_fakes_follow_the_value(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "v string")
    for name in [n for n in A.OPERATORS if n.startswith("fake_")]:
        x, y, z = (r[0] for r in df.select(A.operator(name)(F.col("v"))).collect())
        assert x == y and x and x != z, name
        assert df.select(A.operator(name, {"salt": "s"})(F.col("v"))).first()[0] != x
    cards = spark.range(200).select(A.operator("fake_credit_card")(F.col("id").cast("string")).alias("c"))
    assert cards.where(F.call_function("luhn_check", "c")).count() == 200


def test_registry_is_strict():
    for name, params in (("nope", None), ("mask_email", {"x": 1}), ("encrypt", None), ("encrypt", {"key": "short"}), ("hash", {"hash_type": "md5"})):
        with pytest.raises((ValueError, TypeError)):
            A.operator(name, params)(F.lit("x"))
    with pytest.raises(TypeError):
        A.operator("mask_email", {"min_local_part": "5"})(F.lit("x"))
    assert "CA_SIN" in A.supported_entities() and A.operators_for("PERSON")[:2] == ["mask_person", "fake_name"]
    A.register("shout", lambda c: F.upper(c))
    assert A.operator("shout")
    del A.OPERATORS["shout"]


def test_regex_dialect():
    assert java_replacement(r"\2, \1 $5 \g<name>") == r"$2, $1 \$5 ${name}"
    assert java_pattern(r"(?P<a>x)(?P=a)\Z") == r"(?U)(?<a>x)\k<a>\z"
    with pytest.raises(ValueError):
        java_pattern("(")


def test_single_values(spark):
    assert A.anonymize_text(spark, "John Smith", "smart_mask", "PERSON") == "J*** S****"
    assert A.anonymize_text(spark, " ", "redact") == " " and A.anonymize_text(spark, None, "redact") is None


def test_recognizers_from_configuration(spark):
    from tarnflow.operators.detect import best_entity, recognizers_of

    config = {
        "recognizer_registry": {
            "recognizers": [
                {"name": "Badge", "supported_entity": "BADGE", "patterns": [{"name": "b", "regex": r"\bB-\d{4}\b", "score": 0.5}], "context": ["badge"]},
                {"name": "Codename", "supported_entity": "CODENAME", "deny_list": ["Blue Heron"]},
                {"name": "Phones", "supported_entity": "PHONE_NUMBER", "context": ["ring me"]},
                {"name": "Own card", "supported_entity": "CREDIT_CARD", "patterns": [{"regex": "[0-9]{16}", "score": 0.9}], "validator": "luhn"},
            ]
        }
    }
    table = recognizers_of(config)
    rows = [("badge B-1234",), ("B-1234",), ("the Blue Heron plan",), ("4242424242424242",), ("4242424242424243",), ("555-123-4567",)]
    got = {r.value: r.entity for r in best_entity(spark.createDataFrame(rows, "value string"), recognizers=table).collect()}
    assert got == {"badge B-1234": "BADGE", "the Blue Heron plan": "CODENAME", "4242424242424242": "CREDIT_CARD", "555-123-4567": "PHONE_NUMBER"}
    for bad in ({"name": "x"}, {"supported_entity": "NEW"}, {"supported_entity": "NEW", "patterns": [{"regex": "a", "score": 1}], "validator": "no"}):
        with pytest.raises(ValueError):
            recognizers_of({"recognizer_registry": {"recognizers": [bad]}})
