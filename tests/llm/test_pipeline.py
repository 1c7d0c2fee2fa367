"""The whole pipeline against a brute-force version of its stages."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

from .conftest import prose
from .test_near_texts import edited, least_ids
from .test_texts import edits


def brute_line_dedup(rows):
    """Without later windows of two lines and later single lines of 50 words or more."""
    first, out = {}, []
    for i, text in rows:
        parts = text.split("\n")
        full, gone = [k for k, p in enumerate(parts) if p.strip(" ")], set()
        for w in (1, 2):
            for j in range(len(full) - w + 1):
                key = tuple(parts[k].strip(" ") for k in full[j : j + w])
                if (w == 2 or len(key[0].split()) >= 50) and first.setdefault(key, (i, j)) != (i, j):
                    gone.update(full[j : j + w])
        out.append((i, "\n".join(p for k, p in enumerate(parts) if k not in gone)))
    return out


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(21)
    passage, block = prose(900, 60), "\n".join(prose(910 + k, 6) for k in range(3))
    items = [(k, prose(950 + k, 15)) for k in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(3000 + i, rng.randint(20, 120))]
        if i % 5 == 0:
            parts.append(passage)
        if i % 7 == 0:
            parts += [block, prose(4000 + i, 10)]
        if i % 11 == 3:
            leak = items[i % 4][1]
            at = rng.randrange(len(leak))
            parts.append(prose(5000 + i, 5) + " " + leak[:at] + "x" + leak[at + 1 :])
        rows.append((i, "\n".join(parts)))
    rows += [(100 + i, edited(rows[i][1].split("\n")[0], rng, i % 3)) for i in range(0, 60, 4)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))  # so all are kept

    kept = brute_line_dedup(rows)
    stay = set(least_ids(kept))
    norm = lambda t: " ".join(t.lower().split()).encode()
    want = {i: t for i, t in kept if i in stay and all(edits(norm(x), norm(t)) > int(0.05 * len(norm(x))) for _, x in items)}
    assert len(want) < len(stay) < len(rows)

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {i: len(encoder.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    assert {p.doc_id: p.doc_tokens for p in pieces} == tokens
    assert sum(p.length for p in pieces) == sum(tokens.values())
