import pytest
from pyspark.sql import functions as F

from kinfold.functions import ascii, compare, text
from kinfold.operators.normalize import normalize

COLUMNS = "entity_id string, business_name string, business_address string, country string, source int"


def views(spark, rows):
    return {r["entity_id"]: r for r in normalize(spark.createDataFrame([(str(i), n, a, c, 1) for i, (n, a, c) in enumerate(rows)], COLUMNS)).collect()}


def test_names_that_are_one(spark):
    pairs = [
        ("Moonlight Bakery Pvt. Ltd.", "MOON LIGHT BAKERY PRIVATE LIMITED"),
        ("Menta1 Health Group", "mental health group"),
        ("CITY [(CENTRE)]", "City Center"),
        ("rivertownbooks.com", "Rivertown Books"),
        ("A & B Partners", "a and b partners"),
        ("M G Tools", "MG Tools"),
    ]
    got = views(spark, [(n, "", "US") for p in pairs for n in p])
    for i in range(len(pairs)):
        assert got[str(2 * i)]["name_nospace"] == got[str(2 * i + 1)]["name_nospace"], pairs[i]
    assert got["6"]["name_is_domain"] and not got["7"]["name_is_domain"]


def test_legal_forms_through_another_script(spark):
    got = views(spark, [("सूरज प्राइवेट लिमिटेड", "", "India")])["0"]
    assert got["name_legal"] == "ltd pvt" and "prvt" not in got["name_skel"]


def test_addresses(spark):
    got = views(spark, [
        ("x", "00420 SECOND ST, SALT SPRINGS, FL", "US"),
        ("x", "420-B 2nd Street, Salt Springs, Florida", "US"),
        ("x", "Maple Trail Dr, <NULL>, Dover, Tennessee", "US"),
        ("x", "77, K.R. Road, Near Bus Stn, Pune - 411001", "India"),
        ("x", "12 bis rue Victor, PO Box 9, Lyon", "France"),
        ("x", "St Mary Rd", "US"),
        ("x", None, None),
    ])
    assert got["0"]["addr_nums"] == got["1"]["addr_nums"] == "420 2"
    assert got["0"]["addr_city"] == got["1"]["addr_city"] == "salt springs"
    assert got["2"]["addr_clean"] == "maple trl dr dover tn"
    assert got["3"]["addr_city"] == "pune"
    assert got["4"]["addr_nums"] == "12" and got["4"]["addr_first_num"] == "12"
    assert got["5"]["addr_clean"] == "saint mary rd"
    assert got["6"]["addr_missing"] and got["6"]["addr_city"] == ""


def column(spark, expr, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


def test_keys(spark):
    assert column(spark, text.skeleton, "praaivett", "private", "laxmi", "lkssmii", "12", "") == ["prvt", "prvt", "lksm", "lksm", "12", ""]
    a, b = column(spark, text.loose_skeleton, "bright infra", "piraitt inhpraa")
    assert a == b
    assert column(spark, text.join_single_letters, "m g road", "a b", "ab c") == ["mg road", "ab", "ab c"]


def test_ascii():
    assert ascii.fold("Crème Brûlée Straße №5") == "creme brulee strasse no5"
    assert ascii.fold("Москва") == "moskva" and ascii.fold(None) == "" and ascii.fold("ＡＢＣ１") == "abc1"


@pytest.mark.parametrize("a,b,jw,sort,set_,partial", [
    ("martha", "marhta", 0.9611, 83.333, 83.333, 83.333),
    ("b a", "a b", 0.0, 100.0, 100.0, 50.0),
    ("acme tools", "acme", 0.88, 57.143, 100.0, 100.0),
])
def test_similarities(a, b, jw, sort, set_, partial):
    if jw:
        assert compare.jaro_winkler(a, b) == pytest.approx(jw, abs=1e-3)
    assert compare.token_sort_ratio(a, b) == pytest.approx(sort, abs=1e-2)
    assert compare.token_set_ratio(a, b) == pytest.approx(set_, abs=1e-2)
    assert compare.partial_ratio(a, b) == pytest.approx(partial, abs=1e-2)


def test_common_subsequence_against_the_table():
    import random

    random.seed(1)
    for _ in range(200):
        a, b = ("".join(random.choice("abc ") for _ in range(random.randint(0, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
        assert compare.common_subsequence(a, b) == row[-1]


def test_unknown_is_null(spark):
    rows = spark.createDataFrame([("", "x"), ("x", ""), ("ab c", "ab d")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = rows.select(compare.levenshtein_sim(a, b), compare.jaccard(a, b), compare.overlap(a, b), compare.same_if_known(a, b), compare.token_set_sim(a, b), compare.prefix_length(a, b), compare.best_number_sim(a, b)).collect()
    assert [tuple(r)[:5] for r in got[:2]] == [(None,) * 5] * 2
    assert got[2][1] == pytest.approx(1 / 3) and got[2][2] == 0.5 and got[2][5] == 3 and got[0][6] is None


def test_partial_ratios_of_many_pairs():
    """Ratios taken together equal a search of every stretch, also beyond 64 letters, and take a fraction of its time."""
    import random
    import time

    from kinfold.functions import compare

    def plain(a, b):
        short, long = sorted((a, b), key=len)
        if not short:
            return 100.0 if not long else 0.0
        return max(compare.ratio(short, long[max(0, at) : at + len(short)]) for at in range(1 - len(short), len(long)))

    random.seed(3)
    text = lambda letters, n: "".join(random.choice(letters) for _ in range(n))
    pairs = [(text("abc ", random.randint(0, 9)), text("abd ", random.randint(0, 9))) for _ in range(2000)] + [(text("abcdefgh ", random.randint(40, 80)), text("abcdefgh ", random.randint(40, 80))) for _ in range(60)]
    assert compare.partial_ratios(pairs) == [plain(a, b) for a, b in pairs] == [compare.partial_ratio(a, b) for a, b in pairs]
    many = [(text("abcdefghijklmnop ", 50), text("abcdefghijklmnop ", 55)) for _ in range(300)]
    start = time.process_time()
    want = [plain(a, b) for a, b in many]
    middle = time.process_time()
    assert compare.partial_ratios(many) == want and time.process_time() - middle < (middle - start) / 4


def test_ratios_of_many_pairs_are_those_of_each():
    """Also with texts of a word and one letter more than a number has bits, of letters beyond Latin, without a word, and long ones; and in half the time."""
    import random
    import time

    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice(rnd.choice(["ab ", "abcdefgh ijkl", "aé日𝒳 \x00b"])) for _ in range(rnd.choice([0, 1, 2, 3, 10, 40, 63, 64, 65, 128, 256, 257])))
    odd = [(word(), word()) for _ in range(1_500)] + [(x, x) for x in (word() for _ in range(30))]
    names = [" ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(8)) for _ in range(80)]
    pairs = [(a, b) for a in names for b in names]
    once = (compare.common_subsequence, compare.ratio, compare.token_sort_ratio, compare.token_set_ratio, compare.partial_ratio, compare.jaro_winkler)
    many = (compare.common_subsequences, compare.ratios, compare.token_sort_ratios, compare.token_set_ratios, compare.partial_ratios, compare.jaro_winklers)
    for one, all_ in zip(once, many):
        assert all_(odd) == [one(a, b) for a, b in odd]
    start = time.process_time()
    want = [compare.jaro_winkler(a, b) for a, b in pairs], [compare.token_set_ratio(a, b) for a, b in pairs]
    middle = time.process_time()
    assert (compare.jaro_winklers(pairs), compare.token_set_ratios(pairs)) == want and time.process_time() - middle < (middle - start) / 2
