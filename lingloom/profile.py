"""What a script's words look like; every statistic takes a profile, so that it is not bound to one writing system."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScriptProfile:
    """run: a character class of the script's characters, as a regular expression without brackets; stop: characters that
    no entity holds; n-grams are counted from ngram_min to ngram_max and aligned from align_min to align_max."""

    run: str
    stop: str = ""
    ngram_min: int = 2
    ngram_max: int = 4
    align_min: int = 3
    align_max: int = 4
    terminators: str = "。！？…\n"

    @property
    def run_regex(self) -> str:
        return f"[{self.run}]+"


# The ranges of Chinese characters and the particles and pronouns that cut entities.
CJK = ScriptProfile(run="一-鿿㐀-䶿", stop="的了着在是不也就和与到以得真啊嘆哎一我你他她它这那哪其个们些么")

#: Small Latin letters; accented ones play the part of characters that have several forms.
LATIN = ScriptProfile(run="a-zà-öø-ÿ", stop="", terminators=".!?…\n")
