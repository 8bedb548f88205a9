"""Token ids against the contract's call: the tokenizer freshly loaded, with add_special_tokens=False."""

import pytest

pytest.importorskip("panelkit.llm")
from panelkit.llm.queries import tokenizer_path  # noqa: E402
from panelkit.llm.tokens import Encoder  # noqa: E402


def test_added_tokens_equal_a_fresh_library():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenizer_path())
    x = "<|endoftext|>"
    around = ["", " ", "  ", "\n", "\n\n ", "\t", "\xa0", "a", "B", "é", "中", "1", ".", "...", "'s", "<", "|>", " the", "x. "]
    texts = [a + x + b for a in around for b in around]
    texts += [x + x, f"a {x}{x} b", x[:-1], x[1:], x.upper(), f"<{x}>", "plain words only.", None, "", f"one {x} two {x}", "after it, plain"]
    got = Encoder(tokenizer_path(), most=20)(texts, group_chars=200)
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == (fresh.encode(t, add_special_tokens=False).ids if t else []), t
    assert got[texts.index(f"one {x} two {x}")].tolist().count(50256) == 2
