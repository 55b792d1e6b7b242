from tidemark.streaming.new_files import load_logged_batches, load_new_files, new_files, run_available

__all__ = ["load_logged_batches", "load_new_files", "new_files", "run_available"]
