import pytest

from quakeloom.llm import confusables
from quakeloom.llm.confusables import look_form

SAME = [
    ("a b", "a  b"), ("café", "café"), ("Ａbc", "Abc"), ("x​y­", "xy"), ("асе and", "ace and"), ("Ⅳ", "IV"),
    ("ﬁn", "fin"), ("a\r\nb", "a\nb"), ("пoпpавка", "поправка"), ("Η", "H"), (";", ";"),
    ("διάλoγο", "διάλογο"), ("Ѕеnyora", "Senyora"), ("coŀlegi", "col·legi"), ("ά", "ά"),
    ("a‐b", "a-b"), ("wait․", "wait."), ("ouiǃ", "oui!"), ("", ""), ("​", ""), ("а la сорa", "a la copa"),
]
DIFFERENT = [("2²", "22"), ("l'a", "l’a"), ("a—b", "a-b"), ("a–b", "a—b"), ("Café", "Cafe"), ("A", "a"), ("a b", "ab"), ("a\nb", "a b"), ("и", "u"), ("ç", "c")]


@pytest.mark.parametrize("a, b", SAME)
def test_same_look(a, b):
    assert look_form(a) == look_form(b)
    assert look_form(look_form(a)) == look_form(a)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_other_look(a, b):
    assert look_form(a) != look_form(b)


def test_the_script_of_the_document_decides():
    assert look_form("сор и да") == "сор и да"
    assert look_form("cop и да") == "сор и да"
    assert look_form("cop and") == "cop and"
    assert look_form("ΝΑ ΤΟ ΒΗΜΑ λόγο") == look_form("NA TO BHMA λόγο") == "ΝΑ ΤΟ ΒΗΜΑ λόγο"


def test_pairs(spark):
    long = "parlament " * 30_000
    rows = [(1, "cafe"), (2, "cаfe"), (3, "cafe"), (3, "cafe"), (4, "cafе"), (5, None), (6, ""), (7, "​"), (8, long), (9, long.replace("a", "а")), (10, "other")]
    got = sorted(map(tuple, confusables.look_alikes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    assert got == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (6, 7), (8, 9)]
    forms = {r.doc_id: r.form for r in confusables.to_one_form(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert forms[2] == "cafe" and forms[5] is None and forms[7] == "" and forms[9] == long.strip()
    assert confusables.look_alikes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


PUBLIC = [("νote", "vote"), ("ρay", "pay"), ("ιt", "it"), ("αpple", "apple"), ("ϲat", "cat"), ("ɑpple", "apple"), ("ոote", "note"), ("Ꭺpple", "Apple")]


def test_public_table(spark, tmp_path):
    looks = confusables.look_table(spark)
    speller = confusables.Speller(looks)
    for a, b in PUBLIC + SAME:
        assert speller.form(a) == speller.form(b), (a, b)
        assert speller.form(speller.form(a)) == speller.form(a)
    for a, b in DIFFERENT:
        assert speller.form(a) != speller.form(b), (a, b)
    for c in map(chr, range(128)):  # what makes ASCII texts their own form
        assert speller.form("é " + c) == ("é " + c).strip()
    (tmp_path / "list.txt").write_text("# list\n03BD ;\t0076 ;\tMA\t# nu\n\n0441 ; 0063 ; MA\n")
    own = confusables.Speller(confusables.look_table(spark, str(tmp_path / "list.txt")))
    assert own.form("νote") == "vote" and own.form("ρay") == confusables.look_form("ρay")


def test_counts_of_tokens(spark):
    docs = spark.createDataFrame([(1, "cop and Ѕеnyora é"), (2, "plain"), (3, None), (4, "")], "doc_id bigint, text string")
    got = {r.doc_id: (r.form, r.mixed, r.whole) for r in confusables.to_one_form(docs).collect()}
    assert got == {1: ("cop and Senyora é", 1, 0), 2: ("plain", 0, 0), 3: (None, None, None), 4: ("", 0, 0)}


def test_classes_have_a_row_for_each_document(spark):
    rows = [(i, "same text") for i in range(5)] + [(9, "ѕame text"), (8, "sаme text"), (7, "other"), (6, None), (9, "ѕame text")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(confusables.look_classes(docs).collect())
    assert [tuple(r) for r in got] == [(i, 0, 3) for i in (0, 1, 2, 3, 4, 8, 9)]
    assert confusables.look_classes(docs.limit(0)).count() == 0
