"""Tables of a model and its reports, and what is computed from them, as DataFrame transformations.

Every table has a project_id, so that one job analyses many projects. Rows that come from an ordered
list have their place in it as ord.
"""
