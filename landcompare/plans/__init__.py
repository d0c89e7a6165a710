"""Study against datasets, and the whole report of a level."""
