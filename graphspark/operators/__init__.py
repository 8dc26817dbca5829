"""Graph transforms, the five primitives, and the algorithms that are made of them."""
