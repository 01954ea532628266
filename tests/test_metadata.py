"""Indented lists against a stack."""

import random

import pytest

from wardline.sources import metadata


def stack_paths(levels, names):
    indents, path, out = [0], [""], []
    for level, name in zip(levels, names, strict=True):
        while level < indents[-1]:
            indents.pop()
            path.pop()
        if level > indents[-1]:
            indents.append(level)
            path.append(name)
        else:
            indents[-1], path[-1] = level, name
        out.append(list(path))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_label_paths_equal_a_stack(spark, seed):
    rng, files, want = random.Random(seed), [], []
    for f in range(4):
        levels = [rng.choice([0, 1, 2, 5, 8, 9]) for _ in range(60)]
        names = [f"n{k}" for k in range(60)]
        lead = lambda n: "\t" * (n // 8) + " " * (n % 8)
        body = "\n".join(f"c{k}='{lead(v)}{n} &nbsp;<BR>x'" for k, (v, n) in enumerate(zip(levels, names, strict=True)))
        files.append((f"f{f}", f"x\nLABEL /* one */ {body} /* a;b */\n/* c */ last='y' ; z='no'"))
        want += [(f"f{f}", f"c{k}", "one", p) for k, p in enumerate(stack_paths(levels, [f"{n} x" for n in names]))] + [(f"f{f}", "last", "a;b\nc", ["y"])]
    got = metadata.label_records(spark.createDataFrame([*files, ("none", "no statement")], "file string, text string"))
    assert sorted((r.file, r.codename, r.comment, r.path) for r in got.collect()) == sorted(want)


def test_table_keys_number_columns_through_a_file(spark):
    text = "# file a\n# P1. First [3]\n# about\n# it\nx\n\ty\n\tz\n# P2. Second [9]\nq\n\t\tdeep\n# file b\n# PCT3. Third [1]\nr\n"
    got = metadata.table_keys(spark.createDataFrame([("l", text)], "file string, text string")).collect()
    rows = sorted((r.file, r.column, r.table, r.description, r.found == r.expected, r.path, r.jump) for r in got)
    assert rows == [
        ("a", 5, "P1", "about\nit", True, ["x"], False), ("a", 6, "P1", "about\nit", True, ["x", "y"], False), ("a", 7, "P1", "about\nit", True, ["x", "z"], False),
        ("a", 8, "P2", "", False, ["q"], False), ("a", 9, "P2", "", False, ["q", "deep"], True), ("b", 5, "PCT3", "", True, ["r"], False),
    ]


def test_too_many_indents_raise(spark):
    rows = [(1, k, k, "n") for k in range(metadata.MOST_LEVELS + 1)]
    with pytest.raises(ValueError):
        metadata.ancestors(spark.createDataFrame(rows, "g int, pos int, level int, name string"), ["g"])
