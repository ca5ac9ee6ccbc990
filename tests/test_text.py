import sys
import unicodedata

from pyspark.sql import functions as F

from graphproof.functions import text as tx


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    out = rows.select("i", expression(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(out, key=lambda r: r["i"])]


def test_newlines_become_lf(spark):
    assert column(spark, ["a\r\nb\rc\n\r"], tx.normalize_newlines) == ["a\nb\nc\n\n"]


def test_composing_equals_unicodedata(spark):
    values = ["é", "plain", "가", "각", "ḍ̇", "Å", None, "日本か\u3099", "שּׁ", ""]
    want = [None if v is None else unicodedata.normalize("NFC", v) for v in values]
    assert column(spark, values, tx.compose) == want


def test_ranges_taken_as_composed_are_so():
    import re

    safe = re.findall(r"\\x\{([0-9A-F]+)\}-\\x\{([0-9A-F]+)\}", tx._COMPOSED_RANGES)
    second = set()  # characters that may combine with the one before
    for code in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            second.add(int(parts[1], 16))
    second |= set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for low, high in safe:
        for code in range(int(low, 16), int(high, 16) + 1):
            char = chr(code)
            assert unicodedata.normalize("NFC", char) == char, hex(code)
            assert unicodedata.combining(char) == 0, hex(code)
            assert code not in second, hex(code)


def test_lookup_key_trims_unicode_space_and_lowers(spark):
    values = ["\u3000 Ab\u0085", "\u00a0x\t", "\u001fx", "ΟΔΟΣ", " \n"]
    assert column(spark, values, tx.lookup_key) == ["ab", "x", "\u001fx", "οδος", ""]


def test_lookup_keys_work_on_arrays(spark):
    values = [[" A ", "É"], [], ["가"]]
    assert column(spark, values, tx.lookup_keys, "array<string>") == [["a", "é"], [], ["가"]]


def test_lookup_keys_keep_awkward_elements(spark):
    values = [["e\u0301", None, 'a"\\n', "x\ny", "n\u0301", "\u0301"], [None], None, ["\u3000"], ["\U0001d15e", "\x00"]]
    want = [["é", None, 'a"\\n', "x\ny", "ń", "\u0301"], [None], None, [""], ["\U0001d157\U0001d165", "\x00"]]
    assert column(spark, values, tx.lookup_keys, "array<string>") == want


def test_trimming_strips_all_white_space_and_nothing_else(spark):
    import re

    odd = "\t\n\x0b\x0c\r\x1c\x1f \x85\xa0\u1680\u180e\u2000\u200a\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
    values = [c + "a" + c + "b" + c for c in odd] + [odd, "", " \u3000", None]
    space = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    want = [None if v is None else re.sub(rf"\A{space}|{space}\Z", "", v) for v in values]
    assert column(spark, values, tx.trim_unicode) == want


def test_lists_are_not_handed_over_row_by_row(spark):
    """Arrow lists took the square of a batch: a hundred thousand rows took as long as ten million texts."""
    import time

    keys = tx.lookup_keys(F.array(F.concat(F.lit("a"), "id")))
    count = lambda n: spark.range(0, n, 1, 1).select(F.sum(F.size(keys))).collect()
    count(10)
    start = time.process_time(), time.perf_counter()
    count(400_000)
    assert time.perf_counter() - start[1] < 8


def test_machine_keys(spark):
    values = ["a.b:c-d_1", "", "é", "a b", "abc\n"]
    assert column(spark, values, tx.is_machine_key) == [True, False, False, False, False]


def test_front_end(spark):
    values = ["---\nid: x\n---\n# B", "---\n---\n", "---\nid: x\n---", "# B", "\ufeff---\na\n---\n"]
    assert column(spark, values, tx.front_end) == [14, 0, 0, 0, 0]


def test_line_at_is_one_based(spark):
    assert column(spark, ["a\nb\nc"], lambda c: tx.line_at(c, F.lit(4))) == [3]


def test_occurrences_do_not_overlap(spark):
    assert column(spark, ["aaaaa"], lambda c: tx.occurrences(c, F.lit("aa"))) == [2]


def test_path_predicates(spark):
    values = ["a/./b//c", "/a", "../a", "a/..b", "a/../b", ""]
    assert column(spark, values, tx.path_key)[0] == "a/b/c"
    assert column(spark, values, tx.is_absolute) == [False, True, False, False, False, False]
    assert column(spark, values, tx.leaves_root) == [False, False, True, False, True, False]


def test_few_texts_are_composed_at_once():
    """A batch of 4,000 texts of 10 KB: Python's copies of them stay small beside the batch; nulls stay null."""
    import tracemalloc

    import pyarrow as pa

    from graphproof.functions.text import _composed

    texts = pa.array([None if i % 10 == 0 else "é" + "漢" * 3000 for i in range(4000)], pa.string())
    tracemalloc.start()
    out = _composed(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pylist() == [None if i % 10 == 0 else "é" + "漢" * 3000 for i in range(4000)]
    assert peak < 5_000_000
