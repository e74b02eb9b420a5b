"""The ways to make a CSD's tables, by name."""

from __future__ import annotations

import numpy as np

from popspark.model import coalescent
from popspark.model.adaptive import adaptive_tables
from popspark.model.hmm import Tables
from popspark.model.spectral import spectral_tables
from popspark.sources.models import Epoch, Params

CORES = ("auto", "spectral", "adaptive", "steps")
#: Trunk styles whose lineages do not change within a piece of time, so that the spectral core is exact.
HELD = ("simple", "oldcake", "meancake", "multicake", "multicakeupdating", "exactcake")


def made(core: str, epochs: tuple[Epoch, ...], bounds: list[float], trunk: np.ndarray, deme: int, params: Params, loci: int = 1, style: str = "migratingethan", one_event: bool = True, cake: str = "average", per_piece: int = coalescent.STEPS, tolerance: float = 1e-9) -> Tables:
    """Tables by one of CORES. spectral: closed forms, for constant rates; where trunks migrate, they are held at the mean of a
    piece's ends. adaptive: steps with error control, for all rates. steps: so many steps a piece. auto: spectral where it is
    exact and the matrices can be diagonalized, adaptive elsewhere."""
    same = (epochs, bounds, trunk, deme, params, loci, style, one_event)
    if core not in CORES:
        raise ValueError(f"no core is called {core}")
    if core == "spectral":
        return spectral_tables(*same, cake=cake)
    if core == "steps":
        return coalescent.tables(*same, per_piece=per_piece, cake=cake)
    if core == "auto" and style in HELD and not any(any(e.growth) for e in epochs if e.pulse is None):
        try:
            return spectral_tables(*same, cake=cake)
        except ValueError:
            pass
    return adaptive_tables(*same, cake=cake, tolerance=tolerance)
