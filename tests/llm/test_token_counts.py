import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from molgrid.llm import token_counts as tc

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute(word, model):
    word = tc.MARK + word
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            piece = word[start:end]
            if piece in model.pieces:
                score, n = model.pieces[piece]
            elif end - start == 1:
                score, n = model.spelled(piece)
            else:
                continue
            own = (best[start][0] + score, best[start][1] + n)
            if best[end] is None or (own[0], -own[1]) > (best[end][0], -best[end][1]):
                best[end] = own
    return best[-1][1], best[-1][0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Zs", "Cc", "Zl", "Zp"]), min_size=1, max_size=25), min_size=1, max_size=6))
def test_against_plain_dynamic_programming(words):
    model = tc.vocabulary(MODEL)
    trie = tc.Trie(model, most_nodes=40, most_words=8)  # starts afresh again and again
    trie.add(set(words))
    for w in words:
        n, score = brute(w, model)
        assert trie.counts[w][0] == n and abs(trie.counts[w][1] - score) < 1e-9


def test_shared_prefixes_are_computed_once():
    trie = tc.Trie(tc.vocabulary(MODEL))
    trie.add({"prefixes", "prefixed", "prefix"})
    assert trie.nodes == 1 + len("▁prefixe") + 2


def test_edge_rows(edge_docs, edge_rows, no_docs):
    model = tc.vocabulary(MODEL)
    got = sorted(((r.doc_id, r.n_words, r.n_tokens) for r in tc.token_counts(edge_docs, MODEL).collect()), key=repr)
    want = [(d, len((t or "").split()), sum(brute(w, model)[0] for w in (t or "").split())) for d, t in edge_rows]
    assert got == sorted(want, key=repr)
    assert tc.token_counts(no_docs, MODEL).count() == 0
