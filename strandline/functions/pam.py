"""PAM patterns: a guide's neighbouring motif, parsed when a plan is made."""

from __future__ import annotations

import re
from dataclasses import dataclass

# IUPAC nucleotide codes.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
# Named systems and their motifs, the guide's place marked by a dot.
PRESETS = {"SpCas9": ".NGG", "SaCas9N": ".NGRRN", "SaCas9T": ".NGRRT", "NmeCas9": ".NNNNGATT", "CjCas9": ".NNNNRYAC", "StCas9": ".NNAGAAW", "Cas12a": "TTTV.", "AacCas12b": "TTN.", "BhCas12b": "DTTN."}


@dataclass(frozen=True)
class Pam:
    """A motif with one dot for the guide and the guide's length."""

    pattern: str
    length: int = 20

    @classmethod
    def parse(cls, text: str, length: int = 20) -> Pam:
        """A preset, or a motif.  Without a dot the guide stands before a motif that starts
        with N, and after any other that holds an N; one without N gets a spacer N and
        follows the guide."""
        named = {k.lower(): v for k, v in PRESETS.items()}.get(text.lower())
        motif = named or text.upper()
        if "." not in motif:
            motif = motif if "N" in motif else "N" + motif
            motif = "." + motif if motif.startswith("N") else motif + "."
        return cls(motif, length)

    def _class(self, motif: str) -> str:
        out, inside = [], False
        for ch in motif:
            if ch in "[]":
                inside = ch == "["
                out.append(ch)
            elif ch in IUPAC and len(IUPAC[ch]) > 1:
                out.append(IUPAC[ch] if inside else f"[{IUPAC[ch]}]")
            else:
                out.append("T" if ch == "U" else ch)
        return "".join(out)

    @property
    def before(self) -> str:
        return self._class(self.pattern.split(".")[0])

    @property
    def after(self) -> str:
        return self._class(self.pattern.split(".")[1])

    @staticmethod
    def longest(motif: str) -> int:
        """The largest number of bases that a motif with classes and {n,m} counts covers."""
        total = 0
        for m in re.finditer(r"(\[[^\]]*\]|[^{}\[\]])(?:\{(\d*),?(\d*)\})?", motif):
            total += int(m[3] or m[2] or 1)
        return total

    @property
    def widths(self) -> tuple[int, int]:
        return self.longest(self.before), self.longest(self.after)

    @property
    def regex(self) -> str:
        """The pattern with look-around, for single strings."""
        left = f"(?<={self.before})" if self.before else ""
        right = f"(?={self.after})" if self.after else ""
        return f"{left}.{{{self.length}}}{right}"
