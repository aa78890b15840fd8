"""Rule sets of the line cleaner, as data.

The lists below are fixed values: they must match the documents' own phrases.
All are searched without regard to case but the headers, which are whole lines.
"""

from __future__ import annotations

from dataclasses import dataclass

CUTOFF = (
    r"this review.*used.*assessment aid",
    r"this review was conducted.*assessment aid",
    r"this review used.*(real-time oncology review|rtor)",
    r"this review was conducted under project orbis",
    r"the application was granted.*(breakthrough|orphan)",
    r"granted.*(priority review|breakthrough designation|orphan drug designation)",
    r"received.*(priority review|breakthrough designation|orphan drug designation)",
)
BOILERPLATE = (
    r"follow the oncology center of excellence",
    r"follow us on x",
    r"healthcare professionals should report all serious adverse events",
    r"(view |see )?full prescribing information for\s",
    r"for assistance with single-patient inds for investigational oncology products",
    r"fda expedited programs are described in the guidance",
    r"a description of fda expedited programs is in the guidance",
    r"for information on the covid-19 pandemic",
    r"fda: coronavirus disease 2019 \(covid-19\)",
    r"cdc: coronavirus \(covid-19\)",
)
HEADERS = ("Efficacy and Safety", "Recommended Dosage", "Expedited Programs")
DOSAGE = (
    r"\d\s*(kg|mg|g|mcg)",
    r"(less|greater) than.*\d",
    r"\d\s*(or|and)\s*(greater|less)",
    r"orally.*(twice|once).*daily",
    r"mg.*orally",
)
HORIZON = 15  # lines looked ahead


@dataclass(frozen=True)
class Rules:
    cutoff: tuple[str, ...] = CUTOFF
    boilerplate: tuple[str, ...] = BOILERPLATE
    headers: tuple[str, ...] = HEADERS
    dosage: tuple[str, ...] = DOSAGE
    horizon: int = HORIZON

    @property
    def cutoff_re(self) -> str:
        return "|".join(self.cutoff)

    @property
    def boilerplate_re(self) -> str:
        return "^(" + "|".join(self.boilerplate) + ")"

    @property
    def dosage_re(self) -> str:
        return "|".join(self.dosage)
