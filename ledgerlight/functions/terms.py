"""Many terms found in one pass over each text, by an automaton of all lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_TERMS = 200_000  # a list goes to every task whole

Lists = dict[str, dict[str, list[str]]]


def table_lists(terms: DataFrame, most: int = MOST_TERMS) -> Lists:
    """Lists by language and group from a table ``lang, group, term``; refused beyond ``most`` rows, as every task holds them all."""
    rows = terms.select("lang", "group", "term").filter("term <> ''").distinct().orderBy("lang", "group", "term").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    out: Lists = {}
    for lang, group, term in rows:
        out.setdefault(lang, {}).setdefault(group, []).append(term)
    return out


def group_counts(df: DataFrame, id_col: str, lists: Lists, lang_col: str = "lang", text_col: str = "text", other: str = "en") -> DataFrame:
    """Each text's count of every group: the sum of its terms' non-overlapping counts in the lower-cased text.

    Languages without lists take those of ``other``. Terms of a group may overlap each other.
    One map over the texts, whatever the number of terms; null texts count nothing.
    """
    groups = list(dict.fromkeys(g for own in lists.values() for g in own))
    at = {g: i for i, g in enumerate(groups)}
    terms = {lang: {} for lang in lists}
    for lang, own in lists.items():
        for g, words in own.items():
            for w in words:
                terms[lang].setdefault(w, []).append(at[g])
    names, n_groups = [id_col, *groups], len(groups)

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        automata = {}
        for lang, own in terms.items():
            a = ahocorasick.Automaton()
            for k, (w, g) in enumerate(own.items()):
                a.add_word(w, (k, len(w), g))
            a.make_automaton()
            automata[lang] = (a, len(own))
        for b in batches:
            out = [[] for _ in range(n_groups)]
            for lang, text in zip(b.column(1).to_pylist(), b.column(2)):
                a, n = automata.get(lang) or automata[other]
                counts, free = [0] * n_groups, [0] * n
                text = text.as_py()
                if text and n:
                    for end, (k, size, own) in a.iter(text):
                        if end - size + 1 >= free[k]:
                            free[k] = end + 1
                            for g in own:
                                counts[g] += 1
                for column, c in zip(out, counts):
                    column.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int32()) for c in out]], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    ddl = ", ".join([f"`{id_col}` {kind}", *[f"`{g}` int" for g in groups]])
    return df.select(id_col, lang_col, F.lower(text_col).alias("low")).mapInArrow(run, ddl)


def first_groups(df: DataFrame, id_col: str, lists: Lists, priority: list[str], lang_col: str = "lang", texts_col: str = "texts", other: str = "en", rest: str = "rest") -> DataFrame:
    """For a column of text lists: how many texts have each group of ``priority`` as the first of which a term stands in them, ``rest`` for none; matching is on the texts as given."""
    rank = {g: i for i, g in enumerate(priority)}
    terms: dict[str, dict[str, int]] = {lang: {} for lang in lists}
    for lang, own in lists.items():
        for g, words in own.items():
            for w in words:
                terms[lang][w] = min(rank[g], terms[lang].get(w, rank[g]))
    names, n_groups = [id_col, *priority, rest], len(priority)

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        automata = {}
        for lang, own in terms.items():
            a = ahocorasick.Automaton()
            for w, g in own.items():
                a.add_word(w, g)
            a.make_automaton()
            automata[lang] = a
        for b in batches:
            out = [[] for _ in range(n_groups + 1)]
            for lang, texts in zip(b.column(1).to_pylist(), b.column(2)):
                a, counts = automata.get(lang) or automata[other], [0] * (n_groups + 1)
                for text in texts.as_py() or ():
                    best = n_groups
                    for _, g in a.iter(text):
                        if g < best:
                            best = g
                            if not g:
                                break
                    counts[best] += 1
                for column, c in zip(out, counts):
                    column.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in out]], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    ddl = ", ".join([f"`{id_col}` {kind}", *[f"`{g}` long" for g in names[1:]]])
    return df.select(id_col, lang_col, texts_col).mapInArrow(run, ddl)
