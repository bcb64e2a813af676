"""Training-data operators: one module per operator, ``queries`` registers them.

Nothing else in the library imports this subpackage; it uses only general helpers
(``riskframe.session.cut_lineage``) from the rest.
"""
