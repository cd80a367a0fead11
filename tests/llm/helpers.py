"""Plain versions and fixtures for the training-data operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


#: Texts that every operator must bear.
ODD = [
    None, "", " ", "\n\n", "a", "a b", "word", "word", "It's  12 o'clock.\n\nNext\tline\r\n", "日本語 テキスト 👍🏽", "x" * 3000,
    "ab " * 2000, "1 " * 1500, "<|endoftext|> <s>", "é é ÅngströM", "\x00zero", " lead", "trail ", "a  b   c", "▁▁x",
]

#: Extra columns whose names operators use inside.
CLASHES = ["score", "label", "digest", "bands", "root", "n_blocks", "range", "guard", "ids", "base", "spans", "found", "component_id", "kept", "shingles", "predicted"]


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < width else (tuple(w[k : k + width]) for k in range(len(w) - width + 1)))


def components(texts, width, percent):
    """For each index the least index reachable over similar pairs."""
    sets = [shingles(t, width) for t in texts]
    least = list(range(len(texts)))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= percent * (len(a) + len(sets[j]) - n):
                x, y = find(i), find(j)
                least[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]
