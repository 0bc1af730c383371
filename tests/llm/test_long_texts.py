"""Very long words and texts in bounded memory, each in a process of its own."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
HEAD = """
import resource, base64, random
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
from tessera.llm import words, token_counts, sentencepiece_codec as codec
model = codec.model_bytes(None)
rng = random.Random(1)
"""

CASES = {
    "one word hashed": "words.word_hashes(['a b'])\nbefore = peak()\nwords.shingle_sets(['x' * 20_000_000])",
    "many words hashed": "words.word_hashes(['a b'])\nbefore = peak()\nwords.word_hashes(['some words ' * 1_000_000])",
    "one word counted": "t = token_counts.Trie(token_counts.unigram_scores(codec.Codec(model)))\nbefore = peak()\nassert t.of_text('abcdefgh' * 200_000)[0] == 1",
    "many words counted": "t = token_counts.Trie(token_counts.unigram_scores(codec.Codec(model)))\nbefore = peak()\nassert t.of_text('some words ' * 1_000_000)[0] == 2_000_000",
    "a run of one letter encoded": "c = codec.Codec(model, 200_000)\nc.encode(['warm up ' * 1000])\nbefore = peak()\nt = 'a' * 2_000_000\nassert c.decode(c.encode([t])[0]) == t",
    "base64 encoded": "c = codec.Codec(model, 200_000)\nc.encode(['warm up ' * 1000])\nbefore = peak()\nt = base64.b64encode(rng.randbytes(4_500_000)).decode()\nassert c.decode(c.encode([t])[0]) == t",
    "unspaced script encoded": "c = codec.Codec(model, 200_000)\nc.encode(['warm up ' * 1000])\nbefore = peak()\nt = ''.join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(1_000_000))\nassert c.decode(c.encode([t])[0]) == t",
}


@pytest.mark.parametrize("name", CASES)
def test_memory_of_one_long_text(name):
    code = HEAD + CASES[name] + "\nprint(peak() - before)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    assert float(out.stdout.split()[-1]) < 300  # MB


def test_long_chunks_have_the_library_s_ids():
    import random

    import numpy as np
    import sentencepiece

    from tessera.llm import sentencepiece_codec as codec

    model = codec.model_bytes(None)
    library, own, rng = sentencepiece.SentencePieceProcessor(model_proto=model), codec.Codec(model), random.Random(5)
    own.indexed = 50
    run, codec.RUN = codec.RUN, 70
    try:
        solid = ["the", "ing", "a", "b", "é", "日", "本", "🙂", ".", "12", "zzz", "aa", "ab"]
        texts = ["".join(rng.choice(solid if k % 2 else [*solid, " ", "  ", "\n", "▁", "\t"]) for _ in range(rng.choice([5, 40, 200]))) for k in range(200)]
        texts += ["a" * 777, "ab" * 500, "aab" * 300, "the" * 400, "".join(rng.choice("ab") for _ in range(3000)), "".join(rng.choice("0123456789abcdef") for _ in range(3000)), ". " * 300, "\n" * 300, " " * 300, "x " * 500]
        assert [np.frombuffer(x, dtype=np.int32).tolist() for x in own.encode(texts)] == library.encode(texts)
    finally:
        codec.RUN = run


def test_long_best_paths():
    import random

    import numpy as np

    from tessera.llm import sentencepiece_codec as codec

    own, rng = codec.Codec(codec.model_bytes(None)), random.Random(6)
    own.kind, own.indexed = codec.UNIGRAM, 50
    for _ in range(60):
        t = "▁" + "".join(rng.choice(["the", "ing", "a", "b", "é", "aa", "日"]) for _ in range(rng.choice([3, 60])))
        _, table = own.edges([t])
        want = own._best(t, table[: len(t)])
        lengths = (table[: len(t)] >= 0).astype(np.uint64) @ (np.uint64(1) << np.arange(table.shape[1], dtype=np.uint64))
        assert np.frombuffer(own._best_long(t, lengths), dtype=np.int32).tolist() == want == np.frombuffer(own._learn([t])[0], dtype=np.int32).tolist()
