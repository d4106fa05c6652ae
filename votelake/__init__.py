"""votelake: weak-supervision analytics over Spark DataFrames.

Annotator votes live in one long table ``votes(id, split, lf, vote)``; every
aggregate, diagnostic, selection rule and label model is a DataFrame plan over
it.  The sub-package for training-data preparation is optional and nothing in
the rest of the library imports it.
"""

ABSTAIN = -1
