"""Training-data operators: each module holds one operator, ``queries`` the registered uses of them."""
