"""Likeness of two texts does not fall because they lie on different sides of a bound of length."""

from airloom.llm import merkle

from .test_operators import make


def test_texts_on_two_sides_of_a_bound_are_alike(spark):
    base = " ".join(f"word{i}" for i in range(60))
    texts = [base[:250], base[:262], base[:44], base[:52], base[:361], "tail of it"]
    got = {r.doc_id: r for r in merkle.fingerprint_edits(make(spark, texts)).collect()}
    assert got[0].near_next > 0.9 and got[2].near_next > 0.8
    assert got[4].near_edited > 0.6
