"""Python patterns for Spark's ``rlike``, which runs Java's engine."""

from __future__ import annotations

import re

# Constructs with no Java counterpart, or with another meaning there.
_REFUSED = {
    r"\(\?\(": "a conditional group",
    r"\(\?[a-zA-Z]*[Lx]": "the flag L or x",
    r"\(\?[imsu]*a[imsu]*[:-]": "a group with the flag a",
    r"\\N\{": "a named character",
    r"\\U": "an eight-digit character code",
}
_TOKEN = re.compile(
    r"\\.|\{(?:\d+(?:,\d*)?|,\d*)\}|\(\?P<|\(\?P=\w+\)|\(\?[aimsu]+\)|\[\^?\]?|.", re.DOTALL
)


def java_pattern(pattern: str) -> str:
    """Translate a Python pattern; raise ``ValueError`` for what cannot be translated."""
    try:
        re.compile(pattern)
    except re.error as error:
        raise ValueError(f"invalid pattern {pattern!r}: {error}") from error
    for refused, label in _REFUSED.items():
        if re.search(r"(?<!\\)" + refused, pattern):
            raise ValueError(f"pattern {pattern!r} uses {label}, which Spark cannot match")
    out: list[str] = []
    in_class = False
    for token in _TOKEN.findall(pattern):
        if in_class:
            if token == "]":
                in_class = False
            elif token.startswith("["):
                token = token.replace("[", "\\[", 1)
                in_class = not token.endswith("]")
            elif token == "&":
                token = "\\&"
        elif token.startswith("["):
            in_class = True
            token = token.replace("]", "\\]")
        elif token.startswith("{"):
            token = "\\{" if token == "{" else token.replace("{,", "{0,")
        elif token == "\\Z":
            token = "\\z"
        elif token == "(?P<":
            token = "(?<"
        elif token.startswith("(?P="):
            token = f"\\k<{token[4:-1]}>"
        elif re.fullmatch(r"\(\?[aimsu]+\)", token):
            token = _global_flags(token)
        out.append(token)
    return "".join(out)


def _global_flags(token: str) -> str:
    kept = "".join(flag for flag in token if flag in "ims")
    ascii_only = "(?-U)" if "a" in token else ""
    return ascii_only + (f"(?{kept})" if kept else "")


def match_at_start(pattern: str) -> str:
    """Pattern that must match from the first character but may end anywhere.

    ``d``: only a newline ends a line. ``U``: digits, letters and blanks of all scripts.
    """
    return rf"(?dU)\A(?:{java_pattern(pattern)})"
