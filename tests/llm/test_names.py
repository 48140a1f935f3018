"""Name variants: readings, comparison, blocking against all pairs, groups and edge cases."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.llm.blocking import pairs_by_key
from quire.llm.name_variants import Common, comparable, components, lcs, link_names, name_pairs, name_tokens, nicknames, read_name, read_names, same_name
from quire.session import shared_dir

COMMON = Common("julian tomas consuelo jimena marta dolores frederick elvira valentina guadalupe guillermo deborah ana beatriz manuel instituto estudios historical society university press asociacion cultural grupo editorial fundacion".split())

READINGS = {
    "Gafujaka V": (["v"], ["gafujaka"]), "ST Pallidran": (["s", "t"], ["pallidran"]), "Prof._Julián_Nebímak": (["julian"], ["nebimak"]),
    "Tigimánes Brebíman Tomás Consuelo": (["tomas", "consuelo"], ["tigimanes", "brebiman"]), "del  Dradrapralla Chajaprando, Jimena": (["jimena"], ["dradrapralla", "chajaprando"]),
    "Inst.Est.Gecidraros": (["inst", "est"], ["gecidraros"]), "SOCIETY, BRECRÓSAHOLM HISTORICAL": (["historical", "society"], ["brecrosaholm"]), "Univ. Press of Vurujasar": (["univ", "press"], ["vurujasar"]),
    "Zoblabara V. Dolores": (["dolores"], ["zoblabara", "v"]), "María Nadie, PhD": (["maria"], ["nadie"]), "D. Julián Nebímak": (["julian"], ["nebimak"]), "Ana Manuel": (["ana"], ["manuel"]), "Madonna": ([], ["madonna"]),
}


def read(raw):
    tokens = name_tokens(raw)
    kin = [COMMON.kin(t) for t in tokens]
    given, last = read_name(tokens, kin)
    return [tokens[i] for i in given], [kin[i] for i in given], [tokens[i] for i in last]


@pytest.mark.parametrize("raw", READINGS)
def test_readings(raw):
    given, _, last = read(raw)
    assert (given, last) == READINGS[raw]


def test_kin():
    assert COMMON.kin("jimenna") == {"jimena"} and COMMON.kin("fund") == {"fundacion"} and COMMON.kin("fdn") == {"fundacion"} and COMMON.kin("gu") == {"guadalupe", "guillermo"}
    assert COMMON.kin("zoblabara") == frozenset() and COMMON.kin("x" * 100_000) == frozenset() and Common([]).kin("ana") == frozenset()


def test_lcs():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = 0
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    words = ["", "a", "abc", "acb", "crehujando", "crehujnado", "bbbb", "abab"]
    assert all(lcs(a, b) == slow(a, b) for a in words for b in words)


SAME = [("Marta Vazegallo", "Vazegallo  Marta"), ("Dol. Zoblabara", "Dolores Zoblabara"), ("F. Huvúbram", "Frederick Huvúbram"), ("Elvira Crehujando", "Elvira Crehujnado"), ("Valentina Gajubran", "Valentina Gajubran Llubrimal"), ("A. C. Trarechaland", "Asociación Cultural Trarechaland"), ("Grupo Ed. Bludabawyn", "Bludabawyn, Grupo Editorial")]
OTHER = [("Guadalupe de la Dilegasa", "Guillermo de la Dilegasa"), ("Ceblevacia Historical Society", "Grupo Editorial Ceblevacia"), ("Dolores Rajódales", "Deborah Rajódales"), ("Ana Cremat", "Ana Brunel")]


def test_comparison():
    assert all(same_name(*read(a), *read(b)) for a, b in SAME)
    assert not any(same_name(*read(a), *read(b)) for a, b in OTHER)


def word(i):
    """An invented surname of its own for each number."""
    return "".join(("bra cre dro fle gri jun kos lam mep nov".split())[int(c)] for c in f"{i:03d}") + "ak"


def corpus(spark, names, heads, copies=30):
    """The names, and fillers that make the words of ``heads`` common."""
    fill = [f"{h} {word(100 * k + i)}" for k, h in enumerate(heads) for i in range(copies)]
    return spark.createDataFrame([(n, "x") for n in [*names, *fill]], "name string, group string")


HEADS = ["Marta", "Dolores", "Frederick", "Elvira", "Valentina", "Asociación Cultural", "Grupo Editorial", "Guadalupe"]


def test_pairs_against_all_pairs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/current_books.parquet").select(F.explode("authors").alias("name"))
    read = {r.name: (list(r.given), [frozenset(k) for k in r.kin], list(r["last"])) for r in read_names(rows, "name").collect()}
    # Sure links of all pairs must be inside one group, whatever the blocks.
    group = {r.name: r.group for r in link_names(rows).collect()}
    assert set(group) == set(read) and not set(group) & {"Desconocido", "Unknown", "Varios Autores", ""}
    for a in read:
        for b in read:
            if a < b and same_name(*read[a], *read[b]) == 2:
                assert group[a] == group[b], (a, b)
    pairs = {tuple(r) for r in name_pairs(rows).collect()}
    assert pairs == {(a, b) for a in group for b in group if a < b and group[a] == group[b]}


def test_common_suffixes_are_refined(spark):
    """With every suffix overly common, the other fields still find the pairs."""
    df = corpus(spark, [x for p in SAME + OTHER for x in p], HEADS)
    for common in (0, 60):
        g = {r.name: r.group for r in link_names(df, common=common).collect()}
        assert all(g[a] == g[b] for a, b in SAME) and not any(g[a] == g[b] for a, b in OTHER)


def test_names_and_types_of_no_list(spark):
    """Invented given names, their nicknames and types of bodies are learnt from the corpus."""
    names = [f"{x} {word(900 + i)}" for i in range(8) for x in (("Zorvald", "Pulo") if i % 2 else ("Mirelune", "Ketty"))]
    names += ["Kollektiv Verlagshaus Tarn", "Tarn, Kollektiv Verlagshaus", "Koll. Verlagsh. Tarn", "Stiftung Tarn", "Pulo Sabrenok", "Zorvald Sabrenok", "Ketty Sabrenok"]
    df = corpus(spark, names, ["Zorvald", "Mirelune", "Osgard", "Kollektiv Verlagshaus", "Stiftung"])
    g = {r.name: r.group for r in link_names(df).collect()}
    assert all(g[names[i]] == g[names[i + 1]] for i in range(0, 16, 2))
    assert g["Kollektiv Verlagshaus Tarn"] == g["Tarn, Kollektiv Verlagshaus"] == g["Koll. Verlagsh. Tarn"] != g["Stiftung Tarn"]
    assert g["Pulo Sabrenok"] == g["Zorvald Sabrenok"] != g["Ketty Sabrenok"]


def test_relatives_teach_no_nickname(spark):
    schema = "tokens array<string>, given array<string>, kin array<array<string>>, last array<string>"
    known = [(["marta", word(i)], ["marta"], [["marta"]], [word(i)]) for i in range(40)]
    odd = [(["zoe", word(i)], ["zoe"], [[]], [word(i)]) for i in (3, *range(50, 60))] + [(["mita", word(i)], ["mita"], [[]], [word(i)]) for i in (4, 5)]
    # Pairs of tokens without kin are read both ways; one surname in eleven is a relative's, two in two are a nickname's.
    df = spark.createDataFrame(known + [(t, g, [[], []][:1], x) for t, g, _, x in odd], schema)
    assert {r.token: r.kin for r in nicknames(df).collect() if r.token in ("zoe", "mita")} == {"mita": ["marta"]}


def test_initials_join_one_group(spark):
    df = corpus(spark, ["Barbara Cezechanes"] * 3 + ["Beatriz Cezechanes", "B. Cezechanes", None, "", "Unknown"], ["Barbara", "Beatriz"])
    g = {r.name: r.group for r in link_names(df).collect()}
    assert len(g) == 63 and g["B. Cezechanes"] == g["Barbara Cezechanes"] != g["Beatriz Cezechanes"]
    assert name_pairs(df.limit(0)).count() == 0


def test_contractions_join_one_group(spark):
    df = corpus(spark, ["Jimena Vazegallo", "Jmna Vazegallo", "Beatriz Vazegallo", "Jmna Perodiz"], ["Jimena", "Beatriz"])
    g = {r.name: r.group for r in link_names(df).collect()}
    assert g["Jmna Vazegallo"] == g["Jimena Vazegallo"] != g["Beatriz Vazegallo"] and len(set(g.values())) == 63


def test_long_and_odd_names(spark):
    df = spark.createDataFrame([("x" * 50_000,), ("…",), ("(Author)",), ("García " * 3_000,), ("Ана Иванова",)], "name string")
    assert link_names(df).count() == 4  # a string without letters is no name
    assert link_names(df.limit(0)).count() == 0


def test_components(spark):
    nodes = spark.range(12)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (7, 8), (9, 9)], "a long, b long")
    got = {r.id: r.group for r in components(nodes, edges).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10, 11: 11}


def features(spark, names):
    """(id, key, and what comparable() reads) of the names, all under one key."""
    rows = []
    for i, n in enumerate(names):
        given, kin, last = read(n)
        rows.append((i, 1, last[0] if last else None, given[0] if given else None, sorted({x[0] for x in [given[0], *kin[0]]}) if given else None))
    return spark.createDataFrame(rows, "id long, key long, surname string, given string, letters array<string>")


def test_blocks_form_only_pairs_that_can_be_linked(spark):
    """Of a hot block only pairs that the comparison can link come out, and none of those is lost."""
    odd = ["Kristina Nebimak", "Cristina Nebimak", "Ermelinda Huvúbram", "Emelinda Huvubram", "Madonna", "Madona", "A. Cremat", "Guadalupe Dilegasamar", "Guadalupe Dilegsamare"]
    names = [*(x for p in SAME + OTHER for x in p), *odd, *(f"Jimena {word(i)}" for i in range(150))]
    df = features(spark, names)
    for most in (4, 2_000):
        got = {tuple(r) for r in pairs_by_key(df, df, most, able=comparable()).collect()}
        can = {(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if same_name(*read(names[i]), *read(names[j]))}
        assert can <= got and len(got) < 0.5 * len(names) * (len(names) - 1) / 2, most


def test_steps_leave_no_files(spark):
    """The files of a step go with it: neither shuffled blocks nor tables of earlier steps are left."""
    df = corpus(spark, ["Jimena Vazegallo", "J. Vazegallo"], HEADS)
    sc = spark.sparkContext
    files = lambda: {f.getName() for f in (x.apply(i) for x in [sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()] for i in range(x.size())) if f.getName().startswith("shuffle_")}
    was = files()
    g = {r.name: r.group for r in link_names(df).collect()}
    assert g["J. Vazegallo"] == g["Jimena Vazegallo"]
    assert len(files() - was) <= 8  # the last step's, if any
    assert not list(Path(shared_dir(spark).removeprefix("file://")).glob("scratch-*"))
