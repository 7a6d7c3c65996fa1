"""DataFrame-to-DataFrame operators; column names and thresholds are parameters.

None of them collects rows, hints a broadcast or joins without keys. Small
sides are broadcast by Spark itself, which checks their size, and a hot key is
either pre-aggregated before the shuffle or split by the adaptive skew join.
"""
