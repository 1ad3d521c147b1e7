"""Reading source trees and extracting nodes and edges."""
