"""Analytics over long-form text corpora, as lazy DataFrame transformations."""
