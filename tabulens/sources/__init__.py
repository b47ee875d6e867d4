"""Project archives as tables of files, and the raw tables of models and reports in them."""
