"""English stop words of the text features.

Fixed values: common English function words. Pass another list to the text operators to
change them.
"""

from __future__ import annotations

STOP_WORDS: tuple[str, ...] = tuple(
    """
    about above after again against all am an and any are as at be because been before
    being below between both but by can cannot could did do does doing down during each
    either else ever few for from further had has have having he hence her here hers
    herself him himself his how however if in into is it its itself just may me might
    more most much must my myself neither no nor not now of off often on once only or
    other others our ours ourselves out over own per quite rather same she should since
    so some still such than that the their theirs them themselves then there therefore
    these they this those though through thus to too under until up upon us very was we
    well were what whatever when where whether which while who whom whose why will with
    within without would yet you your yours yourself yourselves
    """.split()
)
