"""The oracle's SQL for terms, shared by several queries. Written for another engine, apart from the expressions it checks."""

TERM = r"[A-Za-z0-9]+(?:[._/:+-][A-Za-z0-9]+)*|[\x{3400}-\x{9fff}]+"


def bigrams(t: str) -> str:
    return f"list_transform(range(1, length({t})), lambda i: substring({t}, i, 2))"


def terms(c: str) -> str:
    """A list of terms of the text expression ``c``."""
    return f"""flatten(list_transform(regexp_extract_all(lower({c}), '{TERM}'), lambda t:
      CASE WHEN regexp_matches(t, '^[\\x{{3400}}-\\x{{9fff}}]') THEN list_concat(list_transform(range(1, length(t) + 1), lambda i: substring(t, i, 1)), {bigrams('t')})
      ELSE list_concat([t], CASE WHEN len(string_split_regex(t, '[._/:+-]+')) > 1 THEN string_split_regex(t, '[._/:+-]+') ELSE [] END,
        CASE WHEN regexp_matches(regexp_replace(t, '[^a-z0-9]+', '', 'g'), '[0-9]') AND regexp_replace(t, '[^a-z0-9]+', '', 'g') <> t THEN [regexp_replace(t, '[^a-z0-9]+', '', 'g')] ELSE [] END) END))"""


def passage_terms(c: str) -> str:
    return f"""flatten(list_transform(regexp_extract_all(lower({c}), '{TERM}'), lambda t: CASE WHEN regexp_matches(t, '^[\\x{{3400}}-\\x{{9fff}}]') THEN {bigrams('t')} ELSE [t] END))"""


def contains_any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"
