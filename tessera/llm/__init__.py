"""Training-data operators: filtering, mixing, archives, fingerprints, packing,
media columns, token counts and files, quality, near-duplicates.

Nothing outside this folder (but for the top-level pipeline and the guarded
registration) imports it, so it can be removed as a unit.
"""
