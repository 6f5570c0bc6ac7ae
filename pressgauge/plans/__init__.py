"""How the driver's tables stand in for news data, and the queries over them."""
