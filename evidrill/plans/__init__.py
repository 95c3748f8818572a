"""Input views, whole analyses, registered queries, caches, reports."""
