import re

from scanloom.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(window, len(v))
            for k in range(max(1, len(v) - window + 1) if v else 0):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == v[k : k + n]:
                        hit |= set(range(s, s + n))
                        found.add(str(item_id) if item_id is not None else "")
        out.append((doc_id, len(w), len(hit), len(found), bool(hit)))
    return sorted(out, key=str)


def cases(prose):
    item = prose(1, 25)
    w = item.split()
    items = [(1, item), (2, "Alpha beta GAMMA"), (3, ""), (4, None), (5, item), (None, prose(2, 10)), (7, "ka ka ka ka ka ka ka ka ka ka ka")]
    docs = [
        (1, prose(5, 40) + " " + " ".join(w[3:18]).upper() + ", " + prose(6, 5)), (2, " ".join(w[:9])), (3, "x alpha, beta. gamma alpha beta"),
        (4, None), (5, ""), (6, "...!"), (None, item + " " + item), (7, "ka " * 30), (7, "ka " * 30), (8, prose(2, 10) + "\n" + "é" * 5),
        (9, " ".join(w[:12]) + " zz " + " ".join(w[12:])), (10, prose(77, 3000) + " " + " ".join(w[10:20])),
    ]
    return docs, items


def test_equals_brute_force(spark, docs_of, prose):
    docs, items = cases(prose)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = d.decontaminate(docs_of(docs), benchmark).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got], key=str) == brute(docs, items)


def test_empty_tables(spark, docs_of, prose):
    docs, items = cases(prose)
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.contaminated and r.n_items == 0 for r in d.decontaminate(docs_of(docs), none).collect())
    assert d.decontaminate(docs_of([]), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_keep_clean_keeps_columns_and_other_rows(spark, docs_of, prose):
    docs, items = cases(prose)
    table = docs_of(docs)
    kept = d.keep_clean(table, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == table.columns
    clean = [r[0] for r in brute(docs, items) if not r[4]]
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted(clean, key=str)


def test_proximity(spark, docs_of, prose):
    item = "uniquea ka lo mi ta fi uniqueb da ru ne"
    items = d.read_items(spark.createDataFrame([(1, item)], "item_id long, text string"))
    near = "xx uniquea ka lo mi yy ta fi uniqueb da ru ne"
    index = d.build_index(docs_of([(1, item), (2, near), (3, "ka lo mi ta fi da ru ne " * 3)]), items)
    ids = {r.row_: r.doc_id for r in index.rows.collect()}
    found = lambda slop: sorted(ids[r.row_] for r in d.proximity_matches(index, items, slop).collect())
    assert found(0) == [1]
    assert found(2) == [1, 2]


def test_main_path_is_native(spark, docs_of, prose):
    docs, items = cases(prose)
    plan = d.decontaminate(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
