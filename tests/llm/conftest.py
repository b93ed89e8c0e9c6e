import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "omega " * 30_000


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (id, text) or (id, text, lang, source) rows, dealt over three partitions."""
    def make(rows, partitions=3):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)
    return make


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """A folder of tables from DataFrames by name."""
    def make(**tables):
        root = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{root}/{name}.parquet")
        return str(root)
    return make


@pytest.fixture(scope="session")
def corpus():
    """Small corpus of copies, near copies, shared passages, blanks, NULLs, ties and one long text."""
    import random
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = text(60)
    rows = [(i, text(r.randint(5, 120))) for i in range(40)]
    for i in range(40, 60):  # near copies
        ws = rows[i - 40][1].split()
        for _ in range(r.randint(0, 4)):
            ws[r.randrange(len(ws))] = "changed"
        rows.append((i, " ".join(ws)))
    rows += [(60 + i, text(r.randint(3, 30)) + " " + passage + "\n" + text(r.randint(0, 30))) for i in range(8)]
    rows += [(70, rows[3][1]), (71, rows[3][1].upper()), (72, rows[3][1]), (73, ""), (74, None), (75, " \t\n"), (76, "one"), (77, "One"),
             (78, "a b c d"), (79, "a b c d"), (80, "a " * 50), (81, LONG), (82, "line one of it all\nline one of it all\nx\nx"), (83, "naïve café über"),
             (84, "\x0b\x0cvertical\rtab"), (85, " no break space")]
    r.shuffle(rows)
    return rows
