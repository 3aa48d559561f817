"""bookloom - DataFrame operators for large collections of books, web pages and rank boards."""
