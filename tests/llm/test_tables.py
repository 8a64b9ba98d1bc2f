"""Near duplicates and packing against brute force."""

import re
import zlib
from collections import Counter, defaultdict

from riskloom.llm import minmax, packing
from riskloom.llm.queries import tokenizer_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_like_brute_force(spark, corpus):
    rows = [(i, t) for i, t in corpus if i != 3 or t]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    sets = [(i, shingles(t)) for i, t in rows]
    group = {i: {i} for i, _ in sets if i is not None}
    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and a < b and x and y and 100 * len(x & y) >= 85 * len(x | y) and group[a] is not group[b]:
                group[a] |= group[b]
                for m in group[b]:
                    group[m] = group[a]
    want = sorted((str(i), len(x), None if i is None else min(group[i]), i is None or i == min(group[i])) for i, x in sets)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in minmax.near_duplicates(docs).collect())
    assert got == want
    assert minmax.near_duplicates(docs.limit(0)).count() == 0


def test_packing_covers_every_id_once(spark, corpus):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    rows = packing.packed(docs, tokenizer_path("byte_bpe_50k.json"))[0].collect()
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    coded = defaultdict(list)
    for i, t in corpus:
        coded[i].append([*tok.encode(t or "", add_special_tokens=False).ids, 0])
    crc = lambda ids: zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
    covered, sequences = Counter(), defaultdict(list)
    for r in rows:
        assert any(len(x) == r["doc_tokens"] and crc(x[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for x in coded[r["doc_id"]])
        covered[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert covered == {i: sum(map(len, x)) for i, x in coded.items()}
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.packed(docs.limit(0), tokenizer_path("byte_bpe_50k.json"))[0].count() == 0
