"""What workers keep between tasks."""

from tessera.llm import columns
from tessera.llm.packing import encoder


def test_one_thing_is_kept():
    made = []

    def make(x):
        made.append(x)
        return x

    columns.release()
    assert [columns.kept(k, lambda k=k: make(k)) for k in ("a", "a", "b", "b", "a")] == ["a", "a", "b", "b", "a"]
    assert made == ["a", "b", "a"]  # "b" displaced "a"
    assert list(columns._KEPT) == ["a"]
    columns.release()
    assert not columns._KEPT


def test_operators_displace_each_other():
    import public_tokenizers

    from tessera.llm.secrets import cached, default_vocabulary

    first = encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder(public_tokenizers.path("word_bpe_49k.json")) is first
    cached(*default_vocabulary())
    assert len(columns._KEPT) == 1
    assert encoder(public_tokenizers.path("word_bpe_49k.json")) is not first
    columns.release()
